"""Retrieval: prompt tokens, the signal ranker, BM25 and plain baselines.

Queries are a stated set: prompts(prompt_id, prompt), whose number the caller
bounds (`MAX_PROMPTS` a batch, checked), so their tokens may be broadcast; the
files are read once and are never collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import kept
from .codegraph import basename, path_tokens, stem

MAX_PROMPTS = 10_000
MIN_WORD = 4

#: Words that are no search terms.
STOPWORDS = [
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "her", "was", "one", "our", "out", "day", "had", "has", "him", "his", "how", "man", "new",
    "now", "old", "see", "two", "way", "who", "boy", "did", "its", "let", "put", "say", "she", "too", "use", "from", "with", "that", "this", "have", "will",
    "your", "what", "when", "make", "like", "time", "just", "know", "take", "into", "them", "some", "could", "other", "than", "then", "look", "only", "come",
    "over", "also", "back", "after", "first", "well", "even", "want", "any", "way", "been", "which", "their", "work", "fix", "add", "remove", "update",
    "create", "delete", "change", "file", "files", "code", "function", "class", "method", "please", "thanks", "help", "need", "want", "should", "could",
    "would", "show", "tell", "find", "check", "test", "run", "see", "does", "doing", "done", "make", "try", "using", "used", "still", "where", "there",
    "where", "because", "about", "very", "really", "much", "more", "less", "most", "least", "without", "within", "across", "between", "through", "during",
    "before", "after", "above", "below", "under", "over", "same", "different", "new", "old", "good", "bad", "best", "worst", "better", "worse", "maybe",
    "probably", "definitely", "exactly", "actually", "somehow", "instead", "rather", "something", "someone", "somewhere", "anything", "anyone", "anywhere",
    "nothing", "nobody", "nowhere", "everything", "everyone", "everywhere", "lets", "let's", "we're", "we've", "you're", "you've", "they're", "it's",
    "isn't", "wasn't", "weren't", "don't", "doesn't", "didn't", "won't", "wouldn't", "can't", "couldn't", "shouldn't", "haven't", "hasn't", "hadn't",
    "aren't",
]
#: Stop words that become terms where a file is named so.
PROMOTABLE = ["test", "tests", "file", "files", "find", "check", "run", "code", "fix", "add", "make", "use", "show", "create", "update", "delete", "change", "remove"]
#: Terms of code for words of prose.
EXPANSIONS = {
    "duplicate": ["dedup"], "duplicates": ["dedup"], "dedupe": ["dedup"], "deduplicate": ["dedup"], "block": ["guard"], "blocks": ["guard"], "blocking": ["guard"],
    "enormous": ["size", "large"], "huge": ["size", "large"], "big": ["size"], "gigantic": ["size", "large"], "benchmark": ["bench"], "benchmarks": ["bench"], "benchmarking": ["bench"], "bench": ["bench"],
    "simulator": ["replay", "simulate"], "simulation": ["replay", "simulate"], "simulate": ["replay", "simulate"], "adversarial": ["robust", "robustness"], "robustness": ["robust"], "robust": ["robust"],
    "warmup": ["prewarm", "warm"], "evaluation": ["eval"], "evaluate": ["eval"], "statistics": ["stats"], "statistical": ["stats"], "ablation": ["ablate", "ablat"],
    "ranking": ["rank"], "scoring": ["rank", "score"], "penalty": ["penalt"], "penalize": ["penalt"], "penalise": ["penalt"], "savings": ["saving", "save"], "saved": ["save"],
    "authentication": ["auth"], "authenticate": ["auth"], "authenticated": ["auth"], "authenticating": ["auth"], "authorization": ["auth"], "authorize": ["auth"],
    "exception": ["except"], "exceptions": ["except"], "configure": ["config"], "configuration": ["config"], "configured": ["config"], "configuring": ["config"],
    "persistence": ["persist"], "persisting": ["persist"], "persisted": ["persist"], "directory": ["dir"], "directories": ["dir"], "initialize": ["init"], "initialized": ["init"], "initialization": ["init"],
    "comparison": ["compare", "cmp"], "comparing": ["compare", "cmp"], "connection": ["conn"], "connections": ["conn"], "parser": ["parse"], "parsed": ["parse"], "parsing": ["parse"],
    "compiler": ["compile"], "compiled": ["compile"], "compilation": ["compile"], "printer": ["print"], "printing": ["print"], "matcher": ["match"], "matching": ["match"], "matches": ["match"],
    "walker": ["walk"], "walking": ["walk"], "searcher": ["search"], "searching": ["search"],
}
#: Short prompts that only continue, and files that only gather others.
CONTINUATIONS = ["continue", "ok", "yes", "no", "go", "fix it", "do it", "run it", "try again", "retry", "next", "what", "why"]
HUBS = ["mod.rs", "models.py", "index.ts", "index.js", "index.tsx", "index.jsx", "__init__.py", "lib.rs"]
SIGNALS = ["symbol_exact", "symbol_ci", "path_exact", "path_substr", "import", "hot", "test_penalty", "hub_penalty"]

_CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|[_\-\s]+"


def _counted(files: DataFrame) -> tuple[int, list[str]]:
    """The number of files, and the promotable stop words that are parts of their names: one flag a word."""
    parts = F.split(F.lower(stem(basename(F.col("path")))), r"[_\-.]+")
    named = files.select(parts.alias("parts"))
    n, *found = named.agg(F.count("*"), *[F.max(F.array_contains("parts", w)) for w in PROMOTABLE]).first()
    return n, sorted(w for w, there in zip(PROMOTABLE, found, strict=True) if there)


def promoted(files: DataFrame) -> list[str]:
    return _counted(files)[1]


def _stop(named: list[str]) -> list[str]:
    return [w for w in dict.fromkeys(STOPWORDS) if w not in named]


def stop_words(files: DataFrame) -> list[str]:
    return _stop(promoted(files))


def with_tokens(prompts: DataFrame, stop: list[str], min_word: int = MIN_WORD) -> DataFrame:
    """prompts with tokens, distinct terms: words and their camel and snake parts, expansions, then plural and singular forms.

    Each step is a column of its own, so that none is computed twice.
    """
    good = lambda w: (F.length(w) >= min_word) & ~F.lower(w).isin(stop)
    words = F.filter(F.regexp_extract_all("prompt", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), good)
    own = F.array_distinct(F.concat("_words", F.filter(F.flatten(F.transform("_words", lambda w: F.split(w, _CAMEL))), good)))
    table = F.create_map(*[x for k, v in EXPANSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    prose = F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower("prompt"), F.lit("[a-z]+"), F.lit(0))), F.map_keys(table))
    more = F.array_except(F.flatten(F.transform(prose, lambda w: table[w])), F.col("_low"))

    def forms(w: Column) -> Column:
        n = F.length(w)
        cut = lambda k: F.left(w, n - k)
        return F.array_compact(
            F.array(
                w,
                F.when((n >= 5) & w.endswith("ies"), F.concat(cut(3), F.lit("y"))),
                F.when((n >= 5) & w.endswith("es"), cut(2)),
                F.when((n >= 4) & w.endswith("s") & ~w.endswith("ss"), cut(1)),
                F.when((n >= 4) & ~w.endswith("s"), F.concat(w, F.lit("s"))),
            )
        )

    stems = F.filter(F.array_except(F.flatten(F.transform("_lowered", forms)), F.col("_low")), lambda v: F.length(v) >= min_word)
    out = prompts.withColumn("_words", words).withColumn("_own", own).withColumn("_low", F.transform("_own", F.lower)).withColumn("_more", more)
    out = out.withColumn("_lowered", F.transform(F.concat("_own", "_more"), F.lower)).withColumn("_stems", stems)
    return out.withColumn("tokens", F.array_sort(F.array_distinct(F.concat("_own", "_more", "_stems")))).drop("_words", "_own", "_low", "_more", "_lowered", "_stems")


def prompt_paths(prompt: Column) -> Column:
    """Distinct path-like words; no urls, at most four dots, three characters or more."""
    found = F.regexp_extract_all(prompt, F.lit(r"[\w./\-]+(?:/[\w./\-]+|\.[A-Za-z]{1,5})"), F.lit(0))
    dots = lambda p: F.length(p) - F.length(F.replace(p, F.lit("."), F.lit("")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda p: ~p.contains("://") & (dots(p) <= 4) & (F.length(p) >= 3))))


def worth_ranking(prompt: Column, least: int = 15) -> Column:
    p = F.trim(prompt)
    return (F.length(p) >= least) & ~F.lower(p).isin(CONTINUATIONS)


def idf(df: Column, n: Column) -> Column:
    """1 for unknown terms, else between 1 and 1.6."""
    return F.when(F.coalesce(df, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(1.6), F.log((n + 1) / (df + 0.5)) / 2)))


def _squashed(s: Column, by: str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", by), F.lit(by))


def is_test_file(path: Column) -> Column:
    base = F.lower(basename(path))
    return path.rlike(r"(?:^|/)tests?/") | base.rlike(r"^test_|_test\.py$|\.(?:test|spec)\.(?:ts|js)$")


#: Substrings of this length lead terms to paths.
GRAM = 3


def _grams(text: Column, sizes: tuple[int, ...] = (GRAM,)) -> Column:
    """The distinct substrings of these lengths, found in one pass each; of a shorter text, itself."""

    def of(n: int) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.when(F.length(text) < n, F.array(text)).otherwise(found)

    return F.array_distinct(F.flatten(F.array(*map(of, sizes))))


def rank(prompts: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame, frequencies: DataFrame, hot: DataFrame, k: int = 5, without: tuple[str, ...] = ("",)) -> DataFrame:
    """(without, prompt_id, place, path, score, line, symbol, kind): the k best files of each prompt, once per signal left out.

    Whole-number bumps per (file, line), adjusted per line and summed per file;
    ties go to the smaller path.  `without` names the signals of SIGNALS that
    are left out, one at a time ("" for none); all are scored in one pass, each
    bump carrying the bits of those it counts for.  line, symbol and kind are of
    the best line in the first of them.  Terms meet paths through the first
    GRAM characters, an equi-join, before they are compared; a prompt's text
    joins what it met by its number, so it is never copied per term.  Nothing
    is broadcast but by Spark's own check of sizes.
    """
    if prompts.limit(MAX_PROMPTS + 1).count() > MAX_PROMPTS:
        raise ValueError(f"more than {MAX_PROMPTS} prompts in a batch")
    n, named_words = _counted(files)
    N = F.lit(float(max(n or 1, 1)))
    asked = with_tokens(prompts.select("prompt_id", "prompt"), _stop(named_words)).withColumn("paths", prompt_paths(F.col("prompt")))
    asked = kept(asked)
    tokens = asked.select("prompt_id", F.explode("tokens").alias("token")).withColumn("low", F.lower("token"))
    weighed = kept(tokens.join(frequencies.select(F.col("token").alias("low"), "df"), "low", "left").withColumn("idf", idf(F.col("df"), N)))

    def bits(counts) -> int:
        return sum(1 << i for i, w in enumerate(without) if counts(w))

    unless = lambda *signals: bits(lambda w: w not in signals)
    parts = []

    def bump(rows: DataFrame, order: int, line: Column, symbol: Column, kind: Column, score: Column, mask: Column | int) -> None:
        mask = F.lit(mask) if isinstance(mask, int) else mask
        parts.append(rows.select("prompt_id", "path", line.alias("line"), score.cast("long").alias("score"), mask.alias("mask"), F.struct(F.lit(order).alias("order"), symbol.alias("symbol"), kind.alias("kind")).alias("what")))

    one = F.lit(1)
    exact = symbols.join(weighed, symbols["name"] == weighed["token"])
    bump(exact, 0, F.col("line"), F.col("name"), F.col("kind"), F.floor(10 * F.col("idf")), unless("symbol_exact"))
    names = symbols.select("name").distinct()
    lowered = names.groupBy(F.lower("name").alias("low")).agg(F.max("name").alias("name"))  # of names that differ in case, one
    known = weighed.join(names.select(F.col("name").alias("token"), F.lit(True).alias("known")), "token", "left")
    loose = symbols.join(known.join(lowered, "low"), "name")
    bump(loose, 1, F.col("line"), F.col("name"), F.col("kind"), F.floor(8 * F.col("idf")), F.when(F.col("known"), F.lit(bits(lambda w: w == "symbol_exact"))).otherwise(F.lit(unless("symbol_ci"))))

    low, base = F.lower("path"), F.lower(basename(F.col("path")))
    root = stem(base)
    named = files.select("path", low.alias("fl"), root.alias("root"), _squashed(root, "_").alias("under"), _squashed(root, " ").alias("space"))
    file_name, a_file = basename(F.col("path")), F.lit("file")
    forms = asked.select("prompt_id", _squashed(F.col("prompt"), "_").alias("p_under"), F.concat(F.lit(" "), _squashed(F.col("prompt"), " "), F.lit(" ")).alias("p_space"))
    leads = forms.select("prompt_id", F.explode(_grams(F.col("p_under"), (1, 2, GRAM))).alias("lead"))
    hit = F.col("p_under").contains(F.col("under")) | F.col("p_space").contains(F.concat(F.lit(" "), F.col("space"), F.lit(" ")))
    said = named.where((F.length("root") >= 5) & (F.col("under") != "")).withColumn("lead", F.left("under", F.lit(GRAM))).join(leads, "lead").join(forms, "prompt_id").where(hit)
    bump(said, 2, one, file_name, a_file, F.lit(15), unless("path_exact"))
    both = asked.select("prompt_id", F.explode(F.array_distinct(F.transform(F.concat("tokens", "paths"), F.lower))).alias("low"))
    terms = both.join(frequencies.select(F.col("token").alias("low"), "df"), "low", "left").withColumn("idf", idf(F.col("df"), N)).withColumn("lead", F.left("low", F.lit(GRAM)))
    near = named.select("path", "fl", "root", F.explode(_grams(F.col("fl"))).alias("lead")).join(terms, "lead").where(F.col("fl").contains(F.col("low")))
    whole = (F.col("fl") == F.col("low")) | F.col("fl").endswith(F.concat(F.lit("/"), F.col("low"))) | (F.col("low").contains("/") & F.col("fl").contains(F.col("low")))
    spread = F.greatest(F.lit(0.0), 1 - F.coalesce("df", F.lit(0)) / N)
    inside = F.when(F.length("low") < 4, 0).when(F.col("root") == F.col("low"), F.floor(6 * F.col("idf"))).otherwise(F.floor(3 * F.col("idf") * spread))
    by_name, by_part = F.when(whole, F.floor(8 * F.col("idf"))).otherwise(0), F.when(whole, F.floor(8 * F.col("idf"))).otherwise(inside)
    ways = [(by_part, unless("path_exact", "path_substr")), (inside, bits(lambda w: w == "path_exact")), (by_name, bits(lambda w: w == "path_substr"))]
    way = F.explode(F.array(*[F.struct(points.cast("long").alias("points"), F.lit(mask).alias("mask")) for points, mask in ways if mask])).alias("way")
    bump(near.select("prompt_id", "path", way).where("way.points > 0"), 3, one, file_name, a_file, F.col("way.points"), F.col("way.mask"))
    w = Window.partitionBy("module").orderBy("path")
    first = imports.withColumn("at", F.row_number().over(w)).where("at <= 3").select("path", F.lower("module").alias("ml"), F.regexp_replace(F.lower("module"), r"^.*[./]", "").alias("last"))
    used = first.select("path", F.explode(F.array_distinct(F.array("ml", "last"))).alias("low")).join(tokens, "low")
    bump(used, 4, one, F.col("token"), F.lit("importer"), F.lit(3), unless("import"))

    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    counts = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("score")).otherwise(0)).alias(f"s{i}") for i in range(len(without))]
    lines = every.where("mask <> 0").groupBy("prompt_id", "path", "line").agg(*counts, F.min(F.when(F.col("mask").bitwiseAND(1) != 0, F.col("what"))).alias("what"))
    lines = lines.select("prompt_id", "path", "line", "what", F.posexplode(F.array(*[f"s{i}" for i in range(len(without))])).alias("v", "score")).where("score > 0")
    total = lines.groupBy("v", "prompt_id", "path").agg(F.sum("score").alias("score"), F.count("*").alias("n"), F.max_by("what", F.struct("score", -F.col("line"))).alias("what"), F.max_by("line", F.struct("score", -F.col("line"))).alias("line"))

    # adjustments are alike for all lines of a file
    said = asked.select("prompt_id", "prompt", F.array_distinct(F.transform("tokens", F.lower)).alias("lows"))
    total = total.join(files.select("path", path_tokens(F.col("path")).alias("own")), "path").join(said, "prompt_id").join(hot.select("path", F.lit(2).alias("heat")), "path", "left")
    total = total.withColumn("without", F.element_at(F.array(*map(F.lit, without)), F.col("v") + 1))
    on = lambda signal: F.col("without") != signal
    hits = F.size(F.filter("lows", lambda t: F.array_contains("own", t) | ((F.length(t) >= 4) & F.lower("path").contains(t))))
    plow = F.lower("prompt")
    change = (
        F.when(on("path_substr") & (hits >= 2), F.least(F.lit(8), 2 * (hits - 1))).otherwise(0)
        + F.when(on("hot"), F.coalesce("heat", F.lit(0))).otherwise(0)
        - F.when(on("test_penalty") & is_test_file(F.col("path")) & ~plow.contains("test") & ~plow.contains("fixture"), 3).otherwise(0)
        - F.when(on("hub_penalty") & base.isin(HUBS) & ~plow.contains(F.element_at(F.split(base, r"\."), 1)) & ~plow.contains(base), 2).otherwise(0)
    )
    scored = total.withColumn("score", (F.col("score") + F.col("n") * change).cast("long"))
    place = F.row_number().over(Window.partitionBy("without", "prompt_id").orderBy(F.desc("score"), "path"))
    return scored.withColumn("place", place).where(F.col("place") <= k).select("without", "prompt_id", "place", "path", "score", "line", "what.symbol", "what.kind")


def block(ranked: DataFrame, imports: DataFrame, heading: str = "Candidates from the code graph (files not read):") -> DataFrame:
    """(prompt_id, block): the ranked files as lines with place, symbol and kind, and what they import (up to three by name)."""
    has = imports.groupBy("path").agg(F.count("*").alias("n_imports"), F.array_sort(F.collect_list(F.struct("line", "module"))).alias("modules"))
    rows = ranked.join(has, "path", "left")
    user = F.col("kind") == "importer"
    at = F.concat(F.lit("`"), "path", F.when(F.col("line") > 1, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""), F.lit("`"))
    what = F.when(user, F.concat(F.lit("uses `"), "symbol", F.lit("`"))).when(F.col("kind") != "file", F.concat("symbol", F.lit(" ("), "kind", F.lit(")")))
    listed = F.concat(F.lit("imports: "), F.array_join(F.transform("modules", lambda m: m["module"]), ", "))
    needs = F.when(~user & (F.col("n_imports") <= 3), listed).when(~user & (F.col("n_imports") > 3), F.concat(F.col("n_imports").cast("string"), F.lit(" imports")))
    line = F.concat(F.lit("- "), F.array_join(F.array_compact(F.array(at, what, needs)), " · "))
    out = rows.groupBy("prompt_id").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("r"))
    return out.select("prompt_id", F.concat(F.lit(heading + "\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("block"))


# -- BM25 and plain baselines


def words(s: Column) -> Column:
    """Lower-case words of two characters or more, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(s), F.lit("[a-z_][a-z0-9_]*"), F.lit(0)), lambda w: F.length(w) >= 2)


def split_terms(s: Column) -> Column:
    """Distinct lower-case terms of words with their separated and camel parts, two characters or more."""
    found = F.regexp_extract_all(s, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    joined = F.array_join(found, " ")
    pieces = [F.regexp_extract_all(joined, F.lit(p), F.lit(0)) for p in ("[A-Za-z0-9]+", "[a-z]+|[A-Z][a-z]*|[0-9]+")]
    return F.array_distinct(F.transform(F.filter(F.concat(found, *pieces), lambda p: F.length(p) >= 2), F.lower))


#: Scores that a worker holds at once.
_HELD = 1 << 18


def _counting(vocabulary: list[str]):
    """Batches (doc, terms) to (doc, dl, at, tf): a document's length, and which terms of the vocabulary it has how often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for batch in batches:
            terms = batch.column("terms")
            at = pc.fill_null(pc.index_in(terms.flatten().cast(pa.string()), value_set=known), -1).to_numpy()
            row = pc.list_parent_indices(terms).to_numpy()
            keys, tf = np.unique(row[at >= 0].astype(np.int64) * len(known) + at[at >= 0], return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(batch) + 1, dtype=np.int64) * len(known)).astype(np.int32)
            listed = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pc.list_value_length(terms).cast(pa.int64()), listed(keys % len(known)), listed(tf)], ["doc", "dl", "at", "tf"])

    return count


def _scoring(starts: np.ndarray, asking: np.ndarray, weight: np.ndarray, n_queries: int, avgdl: float, k: int | None, k1: float, b: float):
    """Batches (doc, rows) to (q, doc, score, rounded) above 0, with k the k best of each query in a task.

    starts and asking: term t is asked by the queries asking[starts[t]:starts[t + 1]].
    """

    def first(found: pa.Table) -> pa.Table:
        found = found.take(pc.sort_indices(found, [("q", "ascending"), ("rounded", "descending"), ("doc", "ascending")], null_placement="at_start"))
        q = found.column("q").to_numpy()
        return found.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))

    def scored(batch: pa.RecordBatch) -> pa.Table:
        rows = batch.column("rows")
        each = rows.flatten()
        at, sizes = each.field("at"), pc.list_value_length(each.field("at")).to_numpy()
        doc = np.repeat(pc.list_parent_indices(rows).to_numpy().astype(np.int64), sizes)
        dl = np.repeat(each.field("dl").to_numpy(), sizes)
        term, tf = at.flatten().to_numpy(), each.field("tf").flatten().to_numpy().astype(np.float64)
        if len(each) > len(batch):  # rows of one document and length are one
            keys, of = np.unique(np.stack([doc, dl, term]), axis=1, return_inverse=True)
            doc, dl, term = keys
            tf = np.bincount(of.ravel(), tf, keys.shape[1])
        part = weight[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
        n = starts[term + 1] - starts[term]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[term], n)
        total = np.bincount(np.repeat(doc, n) * n_queries + asking[place], np.repeat(part, n), len(batch) * n_queries).reshape(len(batch), n_queries)
        rounded = np.round(total, 9)
        good = total > 0
        if k and len(batch) > k:
            good &= rounded >= np.partition(rounded, len(batch) - k, axis=0)[len(batch) - k]
        doc, q = np.nonzero(good)
        return pa.table({"q": pa.array(q, pa.int32()), "doc": batch.column("doc").take(pa.array(doc)), "score": total[good], "rounded": rounded[good]})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = None, max(1, _HELD // n_queries)
        for batch in batches:
            for at in range(0, len(batch), step):
                found = scored(batch.slice(at, step))
                if k:
                    best = first(found if best is None else pa.concat_tables([best, found]))
                else:
                    yield from found.to_batches()
        if best is not None:
            yield from best.to_batches()

    return score


def bm25(queries: DataFrame, docs: DataFrame, k: int | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, place, doc, score) of queries(query_id, terms) over docs(doc, terms), terms arrays in which a repeat counts as frequency.

    Texts are cut into terms once, in one pass: what leaves it, and is held, is
    a row per document with its length and the counts of the queries' terms.
    The driver sees the stated queries' terms and how many documents hold each.
    Scores are added up per document where its row is, and with k only the k
    best of each query leave a task.  Only scores above 0 come back.
    """
    spark, kind = docs.sparkSession, docs.schema["doc"].dataType
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).where("term is not null").collect()
    names, vocabulary = list(dict.fromkeys(r.query_id for r in asked)), list(dict.fromkeys(r.term for r in asked))
    result = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("doc", kind), T.StructField("score", T.DoubleType()), T.StructField("rounded", T.DoubleType())])
    found = spark.createDataFrame([], result)
    if vocabulary:
        counts = T.StructType([T.StructField("doc", kind), T.StructField("dl", T.LongType()), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("at", "tf")]])
        counted = docs.where("terms is not null").select("doc", "terms").mapInArrow(_counting(vocabulary), counts)
        held = kept(counted.groupBy("doc").agg(F.collect_list(F.struct("dl", "at", "tf")).alias("rows")))
        n, avgdl = held.select(F.explode("rows.dl").alias("dl")).agg(F.count("*"), F.avg("dl")).first()
        v = len(vocabulary)
        keys = F.array_distinct(F.flatten(F.transform("rows", lambda r: F.transform(r["at"], lambda t: r["dl"] * v + t))))
        df = np.zeros(v)
        for at, with_it in held.select(F.explode(keys).alias("key")).groupBy((F.col("key") % v).cast("int")).count().collect():
            df[at] = with_it
        number, term = ({x: i for i, x in enumerate(items)} for items in (names, vocabulary))
        terms, asking = np.array([term[r.term] for r in asked]), np.array([number[r.query_id] for r in asked])
        by_term = np.argsort(terms, kind="stable")
        starts = np.searchsorted(terms[by_term], np.arange(v + 1))
        found = held.mapInArrow(_scoring(starts, asking[by_term], np.log((n - df + 0.5) / (df + 0.5) + 1), len(names), avgdl, k, k1, b), result)
    out = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rounded"), "doc")))
    ids = spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("q", T.IntegerType()), T.StructField("query_id", queries.schema["query_id"].dataType)]))
    return (out.where(F.col("place") <= k) if k else out).join(F.broadcast(ids), "q").select("query_id", "place", "doc", "score")


def _few(queries: DataFrame) -> DataFrame:
    """Queries that every document meets: their number is checked before they are broadcast."""
    if queries.limit(MAX_PROMPTS + 1).count() > MAX_PROMPTS:
        raise ValueError(f"more than {MAX_PROMPTS} queries in a batch")
    return F.broadcast(queries)


def grep_count(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, place, doc, hits): occurrences of the terms in docs(doc, hay); ties to shorter, then larger names."""
    count = lambda t: ((F.length("hay") - F.length(F.replace(F.col("hay"), t, F.lit("")))) / F.length(t)).cast("long")
    hits = F.aggregate("terms", F.lit(0).cast("long"), lambda acc, t: acc + count(t))
    found = docs.join(_few(queries)).withColumn("hits", hits).where("hits > 0")
    return _placed(found, "hits", k)


def overlap(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, place, doc, hits): terms shared with docs(doc, terms); ties to shorter, then larger names."""
    d = docs.select("doc", F.col("terms").alias("own"))
    found = d.join(_few(queries)).withColumn("hits", F.size(F.array_intersect("terms", "own")).cast("long")).where("hits > 0")
    return _placed(found, "hits", k)


def _placed(found: DataFrame, by: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(by), F.length("doc"), F.desc("doc"))
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "place", "doc", by)


def shuffled(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The random baseline: the same order for the same seed and content."""
    return docs.withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "doc"), "doc")))
