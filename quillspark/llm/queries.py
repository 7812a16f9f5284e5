"""The queries opN_<name> over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, infill, mixing, ngram_join, packing, quality, sharding, suffix_radix, suffix_tree, topk, toxicity, url_rules

#: Folder of the public tokenizer files; None takes the installed package's.
TOKENIZER_DIR: str | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZER_DIR:
        return f"{TOKENIZER_DIR}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of a random permutation; law `rows`."""
    out = sharding.shuffle_into_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=40)
    return out.select(
        "doc_id",
        sharding.record_bytes().alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class, copies and number of links (5 words, similarity 0.8)."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=0.8, n=5).drop("th")


#: The contract's rules, in its order.
OP3_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rule, else by its aliases."""
    return url_rules.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), OP3_RULES)


#: DuckDB macros for the SQL below, as subqueries can't hold them: a path without dot segments, and an attribute of a tag.
def _no_dots(p: str) -> str:
    step = f"list_reduce(list_prepend([]::VARCHAR[], [[x] FOR x IN string_split({p}, '/')]), lambda a, x: CASE x[1] WHEN '..' THEN CASE WHEN len(a) > 1 THEN a[:-2] ELSE a END WHEN '.' THEN a ELSE a || x END)"
    last = f"CASE WHEN string_split({p}, '/')[-1] IN ('.', '..') THEN [''] ELSE []::VARCHAR[] END"
    return f"CASE WHEN regexp_matches({p}, '(^|/)\\.\\.?(/|$)') THEN array_to_string({step} || {last}, '/') ELSE {p} END"


def _attr(tag: str, name: str) -> str:
    pattern = rf"""'\s{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))'"""
    out = " || ".join(f"regexp_extract({tag}, {pattern}, {k}, 'is')" for k in (1, 2, 3))
    for reference, character in (("&lt;|&#60;|&#x3c;", "<"), ("&gt;|&#62;|&#x3e;", ">"), ("&quot;|&#34;|&#x22;", '"'), ("&apos;|&#39;|&#x27;", "''"), ("&amp;|&#38;|&#x26;", "&")):
        out = f"regexp_replace({out}, '{reference}', '{character}', 'gi')"
    return f"trim({out})"


def _key(host: str, path: str, url: str) -> str:
    return f"{host} || CASE WHEN {path} = '' THEN '/' ELSE {_no_dots(path)} END || regexp_extract({url}, '^.*?://[^?#]*(\\?[^#]*)?', 1, 's')"


_HOST = "translate(regexp_extract(coalesce({0}, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce({0}, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"

#: Comments, and elements whose content is text: what a reader of tags passes over.
_NO_TAGS = "<!--.*?(?:-->|\\z)|" + "|".join(f"<{e}(?:\\s[^>]*)?>.*?(?:</{e}\\s*>|\\z)" for e in "script style textarea title template xmp iframe noembed noframes".split())


def _seen_from(t: str, url: str, path: str) -> str:
    """A link as an absolute url, seen from a url whose path (never empty) is given."""
    origin, query = f"regexp_extract({url}, '^(.*?://[^/?#]*)', 1, 's')", f"regexp_extract({url}, '^.*?://[^?#]*(\\?[^#]*)?', 1, 's')"
    return f"""CASE WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {t} WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with({t}, '//') THEN regexp_extract({url}, '^(.*?)://', 1, 's') || ':' || {t} WHEN starts_with({t}, '/') THEN {origin} || {t} WHEN starts_with({t}, '?') THEN {origin} || {path} || {t}
    WHEN starts_with({t}, '#') THEN {origin} || {path} || {query} ELSE {origin} || regexp_extract({path}, '^(.*/)', 1, 's') || {t} END"""


OP3_SQL = rf"""
WITH RECURSIVE bare AS (SELECT page_id, url, regexp_replace(html, '{_NO_TAGS}', ' ', 'gis') AS html FROM pages
), parsed AS (
  SELECT page_id, url, coalesce(list_filter([{_attr("t", "href")} FOR t IN regexp_extract_all(coalesce(html, ''), '<base\s[^>]*>', 0, 'is')], lambda h: h <> '')[1], '') AS base, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path, coalesce(contains(url, '://'), false) AS is_url,
    list_filter(regexp_extract_all(coalesce(html, ''), '<link\s[^>]*>', 0, 'is'), lambda t: list_contains(regexp_split_to_array(lower({_attr("t", "rel")}), '\s+'), 'canonical')) AS links,
    list_filter(regexp_extract_all(coalesce(html, ''), '<meta\s[^>]*>', 0, 'is'), lambda t: lower({_attr("t", "http-equiv")}) = 'refresh') AS metas
  FROM bare
), seen AS (
  SELECT *, CASE WHEN is_url THEN {_key("host", "path", "url")} ELSE chr(0) || coalesce(page_id::VARCHAR, '') END AS key FROM parsed
), based AS (
  SELECT key, links, metas, CASE WHEN base = '' THEN url ELSE coalesce({_seen_from("base", "url", "CASE path WHEN '' THEN '/' ELSE path END")}, url) END AS url FROM seen WHERE is_url
), links AS (
  SELECT key, url, CASE {_PATH.format("url")} WHEN '' THEN '/' ELSE {_PATH.format("url")} END AS path, unnest(list_transform(links, lambda t: {_attr("t", "href")}) || list_transform(metas, lambda t: regexp_extract({_attr("t", "content")}, '\burl\s*=\s*["'']?([^"''\s]+)', 1, 'is'))) AS t
  FROM based
), targets AS (
  SELECT key, {_seen_from("t", "url", "path")} AS t FROM links WHERE t <> ''
), parts AS (SELECT key, t, {_HOST.format("t")} AS h, {_PATH.format("t")} AS p FROM targets WHERE contains(t, '://')
), edges AS (SELECT key AS a, {_key("h", "p", "t")} AS b FROM parts
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), component AS (SELECT a AS key, least(a, min(b)) AS component FROM reach GROUP BY a
), rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), judged AS (
  SELECT s.*, coalesce(c.component, s.key) AS component,
    (SELECT max_by({{'rule': h || p, 'verdict': verdict}}, length(h || p) * 1000 + length(h)) FROM rules WHERE (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, p)) AS own
  FROM seen s LEFT JOIN component c USING (key)
), inherited AS (
  SELECT component, CASE WHEN bool_or(coalesce(own.verdict, '') = 'block') AND NOT bool_or(coalesce(own.verdict, '') = 'allow') THEN 'block' ELSE 'allow' END AS v
  FROM judged GROUP BY component
)
SELECT page_id, host, path, own.rule AS rule, coalesce(own.verdict, v) AS verdict, component FROM judged JOIN inherited USING (component)
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in repeated windows of 35 words removed from every document."""
    out = suffix_tree.remove_repeated_words(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=35)
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of every vector whose id is divisible by 50."""
    rows = _table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding"))).select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    return topk.search(rows.where("vec_id % 50 = 0"), rows, k=5)


OP8_SQL = """
WITH e AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM e q JOIN e c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in repeated strings of 200 bytes removed from every document."""
    out = suffix_radix.remove_repeated_bytes(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: A text of at least this expected severity is rejected.
TOXIC_FROM = 0.5


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity; kept is false for toxic ones."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", "expected_severity", "severity", (F.col("expected_severity") < TOXIC_FROM).alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts, fertility measures and verdict."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judge_quality(docs, tokenizer_path("piece_bpe_32k.model")).drop("text", "lang")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of training sequences of at most 4096 tokens."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "step_group")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_documents(docs, tokenizer_path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of the sources by 5, 2, 1 takes."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.mix_with_targets(docs, F.col("source"), mixing.n_words(F.col("text")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: Targets: capped sources are those with the smallest caps a weight; the level is the rest of the words over the other weights.
OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source)) - 1) % 3] AS w FROM d GROUP BY source
), run AS (
  SELECT *, sum(3 * source_size) OVER o - 3 * source_size AS capped_before, sum(w) OVER () - sum(w) OVER o + w AS w_left, sum(source_size) OVER () AS total
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT min_by({'r': total - capped_before, 'w': w_left}, capped_before + w_left * 1e-9) AS x FROM run WHERE (total - capped_before) * w <= 3 * source_size * w_left
), t AS (
  SELECT source, source_size, least(3.0 * source_size::DOUBLE, x.r::DOUBLE * w / x.w::DOUBLE) AS target FROM s, level
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3 * source_size, floor(target + 0.5)::BIGINT) ELSE 0 END AS quota FROM t
), p AS (
  SELECT doc_id, size, source, sum(size) OVER (PARTITION BY source ORDER BY substring(sha256('11:' || coalesce(doc_id::VARCHAR, '') || ':' || text), 1, 24) ROWS UNBOUNDED PRECEDING) - size AS before FROM d
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE size * (quota // source_size) + greatest(0, least(size, quota % source_size - before)) END::BIGINT AS taken
FROM p JOIN q USING (source)
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after ten rounds from eight seeded centers."""
    found = centroids.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)
    out = found.assigned.join(F.broadcast(found.centers), "cluster")  # eight rows
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2("center", 256).alias("centroid_sha256"))


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    near = "(SELECT rid, id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT e.rid, e.id, e.v, c.cluster, list_sum([(e.v[i] - c.v[i]) * (e.v[i] - c.v[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM e, {0} c) GROUP BY rid, id, v)"
    steps = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id AS id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || id::VARCHAR) NULLS LAST, v) - 1)::INTEGER AS cluster, v FROM e QUALIFY cluster < {k})",
    ]
    for r in range(rounds):
        steps.append(f"""m{r} AS (SELECT cluster, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {near.format(f"c{r}")}) GROUP BY cluster, i)""")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM m{r} GROUP BY cluster) m USING (cluster))")
    last = f"a AS MATERIALIZED (SELECT * FROM {near.format(f'c{rounds}')})"
    return f"""WITH {", ".join([*steps, last])}
SELECT a.id AS vec_id, a.cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(a.distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a JOIN c{rounds} USING (cluster)"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, cuts and output, and its text rebuilt from the output."""
    out = infill.fill_in_middle(_table(spark, sf_dir, "documents"), seed=1, share=90, spm_share=20)
    back = infill.restored(F.col("output"), F.col("form"))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]', 0, 's') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), h AS (
  SELECT *, len(t)::BIGINT AS n, ('0x' || x[1:8])::BIGINT % (len(t) + 1) AS a, ('0x' || x[9:16])::BIGINT % (len(t) + 1) AS b, ('0x' || x[17:24])::BIGINT % 100 AS c, ('0x' || x[25:32])::BIGINT % 100 AS e FROM d
), f AS (
  SELECT doc_id, text, n, array_to_string(t[1:least(a, b)], '') AS p, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(t[greatest(a, b) + 1:], '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM f
"""


def queries() -> dict:
    return {"op1_sharding": op1_sharding, "op2_ngram_join": op2_ngram_join, "op3_url_filters": op3_url_filters, "op4_substring_dedup": op4_substring_dedup, "op5_toxicity": op5_toxicity, "op6_packing": op6_packing, "op7_quality_rules": op7_quality_rules, "op8_exact_topk": op8_exact_topk, "op9_suffix_array_dedup": op9_suffix_array_dedup, "op10_bpe": op10_bpe, "op11_mixing": op11_mixing, "op12_centroids": op12_centroids, "op13_fill_in_middle": op13_fill_in_middle}


OP4_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, unnest(range(1, len(w) - 33)) AS p, w FROM d WHERE len(w) >= 35),
h AS (SELECT rid, p, md5(array_to_string(w[p:p + 34], ' ')) AS k FROM win),
dup AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
hit AS (SELECT DISTINCT rid, p FROM h JOIN dup USING (k)),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS i FROM hit),
words AS (SELECT rid, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d),
kept AS (SELECT rid, count(*) FILTER (g.i IS NOT NULL) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY w.i) FILTER (g.i IS NULL), '') AS kept
  FROM words w LEFT JOIN gone g USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""


OP9_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
h AS (SELECT rid, p, md5(substring(x, 2 * p - 1, 400)) AS k FROM (SELECT rid, x, unnest(range(1, length(x) // 2 - 198)) AS p FROM d WHERE length(x) >= 400)),
hit AS (SELECT rid, p FROM h SEMI JOIN (SELECT k FROM h GROUP BY k HAVING count(*) > 1) USING (k)),
run AS (SELECT rid, min(p) AS lo, max(p) + 199 AS hi FROM (SELECT rid, p, sum(CASE WHEN p <= prev + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY p) AS g FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS prev FROM hit)) GROUP BY rid, g),
part AS (SELECT rid, lo, hi, substring(x, 2 * before + 1, 2 * (lo - 1 - before)) AS piece FROM (SELECT *, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS before FROM run) JOIN d USING (rid)),
cut AS (SELECT rid, string_agg(piece, '' ORDER BY lo) AS head, max(hi) AS last, sum(hi - lo + 1) AS removed, count(*) AS spans FROM part GROUP BY rid)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head, '') || substring(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN cut USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_suffix_array_dedup": OP9_SQL, "op4_substring_dedup": OP4_SQL, "op8_exact_topk": OP8_SQL, "op3_url_filters": OP3_SQL, "op11_mixing": OP11_SQL, "op12_centroids": _op12_sql(), "op13_fill_in_middle": OP13_SQL}
