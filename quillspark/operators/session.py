"""Session memory: merge of updates, compaction, diff, tool events to state, restart packets under a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens

SCALARS = ["session_objective", "current_subtask"]
LISTS = ["hard_constraints", "accepted_assumptions", "decisions_made", "modified_files", "tests_run", "failing_signatures", "failed_approaches", "pending_next_actions", "pinned_facts", "recent_turns"]
#: How many of the newest entries compaction keeps.
KEEP = {"recent_turns": 6, "tests_run": 12, "failed_approaches": 12, "pending_next_actions": 8}
#: Commands whose output is worth reducing.
REDUCIBLE = [
    "cargo test", "cargo build", "cargo clippy", "cargo check", "npm test", "npm run test", "npm run build", "npm install", "npm ci", "pnpm test", "pnpm run test", "pnpm run build", "pnpm install",
    "yarn test", "yarn build", "yarn install", "npx jest", "npx vitest", "npx tsc", "npx eslint", "bun test", "bun run test", "bun run build", "bun install", "deno test", "pytest", "python -m pytest",
    "python3 -m pytest", "pip install", "pip3 install", "go test", "go build", "make test", "make build", "make check", "eslint", "gradle build", "gradle test", "mvn test", "mvn compile",
    "dotnet test", "dotnet build", "swift test", "swift build", "flutter test", "dart test",
]


def merged(updates: DataFrame) -> DataFrame:
    """One row per session of updates(session, seq, field, value): scalars keep the last value, lists each value once, in order of first appearance."""
    kept = updates.where("value is not null")
    scalar = kept.where(F.col("field").isin(SCALARS)).groupBy("session").agg(*[F.max_by("value", F.when(F.col("field") == f, F.col("seq"))).alias(f) for f in SCALARS])
    once = kept.where(F.col("field").isin(LISTS)).groupBy("session", "field", "value").agg(F.min("seq").alias("seq"))
    lists = once.groupBy("session").agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("field") == f, F.struct("seq", "value")))), lambda x: x["value"]).alias(f) for f in LISTS])
    return lists.join(scalar, "session", "full")


def compacted(state: DataFrame) -> DataFrame:
    """state with the newest KEEP entries of four lists, and how many went."""
    out = state
    for name, n in KEEP.items():
        size = F.size(name)
        out = out.withColumn(f"removed_{name}", F.greatest(size - n, F.lit(0))).withColumn(name, F.slice(name, F.greatest(size - n + 1, F.lit(1)), n))
    removed = sum((F.col(f"removed_{n}") for n in KEEP), F.lit(0))
    return out.withColumn("compacted", removed > 0)


def added(before: Column, after: Column) -> Column:
    """Items of after that before lacks, repeats and order kept."""
    return F.filter(after, lambda x: ~F.array_contains(before, x))


# -- tests on tool output


def seen(output: Column) -> Column:
    """The lines of an output as array of struct(line, t, low): as they are, trimmed, and that in lower case, each found once."""
    whole = F.transform(T.lines(output), lambda x: F.struct(x.alias("line"), T.trim(x).alias("t")))
    return F.transform(whole, lambda x: F.struct(x["line"].alias("line"), x["t"].alias("t"), T.ascii_lower(x["t"]).alias("low")))


def _fails(lines: Column) -> Column:
    def bad(x: Column) -> Column:
        t, low = x["t"], x["low"]
        marks = T.contains_any(low, ["test result: failed", "compilation failed", "build failed", "panicked at"]) | T.starts_with_any(low, ["error:", "error["])
        own = (t.startswith("test ") & t.endswith("... FAILED")) | T.starts_with_any(t, ["FAIL ", "FAILED ", "✗ ", "✘ ", "× "])
        number = F.regexp_extract(F.rtrim(F.regexp_replace(low, r"(?s)failed.*$", "")), r"[^0-9]([0-9]+)$", 1)
        return marks | own | (low.contains("failed") & number.rlike("[1-9]"))

    return F.exists(lines, bad)


def is_failure(output: Column) -> Column:
    """Any line that marks a failure; `N failed` counts for N > 0 behind something that is no digit."""
    return _fails(seen(output))


def is_success(output: Column, failure: Column) -> Column:
    low = T.ascii_lower(output)
    sure = T.contains_any(low, ["test result: ok", "build succeeded", "finished `", "finished dev", "compiled successfully", "all tests passed"])
    return sure | (T.contains_any(low, ["passed", "0 failed"]) & ~failure)


def _signatures(lines: Column) -> Column:
    def name(x: Column) -> Column:
        t = x["t"]
        return (
            F.when(t.startswith("test ") & t.endswith("... FAILED"), F.regexp_replace(F.regexp_replace(t, "^(?:test )+", ""), r"(?: \.\.\. FAILED)+$", ""))
            .when(t.startswith("FAIL "), T.trim(F.regexp_replace(t, "^(?:FAIL )+", "")))
            .when(T.starts_with_any(t, ["✗ ", "× ", "✘ "]), T.trim(F.substring(t, 2, 1 << 30)))
            .when(t.contains("panicked at") & t.contains("::"), t)
            .when(t.startswith("FAILED "), T.trim(F.regexp_replace(t, "^(?:FAILED )+", "")))
        )

    return F.filter(F.transform(lines, name), lambda x: x.isNotNull() & (x != ""))


def failing_signatures(output: Column) -> Column:
    """What failed, by line: test names, files, panics."""
    return _signatures(seen(output))


def _short(s: Column, most: int) -> Column:
    """Cut on characters, not on bytes."""
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most - 3)), F.lit("..."))).otherwise(s)


def _approach(lines: Column) -> Column:
    return _short(T.first(F.filter(lines, lambda x: T.starts_with_any(x["t"], ["error[", "error:"])))["t"], 140)


def failed_approach(output: Column) -> Column:
    return _approach(seen(output))


def _fact(lines: Column) -> Column:
    marks = ["do not retry", "don't retry", "never retry", "do not use", "must keep"]
    return T.first(F.filter(lines, lambda x: T.contains_any(x["low"], marks)))["t"]


def pinned_fact(output: Column) -> Column:
    return _fact(seen(output))


def command_summary(command: Column) -> Column:
    t = T.trim(command)
    return F.when(t == "", "a tool action").otherwise(_short(t, 120))


_PREFIX = r"""(?s)^(?:(?:(?:cd |pushd |source |\. ).*?&&|env |timeout [0-9]+ |[A-Za-z_][A-Za-z0-9_]*=(?:\\.|'[^']*'|"(?:\\.|[^"\\])*"|[^ \\'"])* )\s*)+"""


def core_command(command: Column) -> Column:
    """The command behind cd, source, env, timeout and variable prefixes."""
    return T.trim(F.regexp_replace(T.trim(command), _PREFIX, ""))


def is_reducible(command: Column) -> Column:
    return T.starts_with_any(core_command(command), REDUCIBLE)


def with_outcome(events: DataFrame) -> DataFrame:
    """events(session, seq, tool, command, path, output) with what each says: outcome, signatures, approach, fact.

    The lines of an output are found in a step of their own, once for all that reads them.
    """
    out = events.withColumn("output", F.coalesce("output", F.lit(""))).withColumn("_lines", seen(F.col("output")))
    lines = F.col("_lines")
    out = out.withColumn("failure", _fails(lines))
    out = out.withColumn("success", is_success(F.col("output"), F.col("failure")))
    return out.withColumns(
        {
            "outcome": F.when(F.col("failure"), "failed").when(F.col("success"), "passed").otherwise("observed"),
            "signatures": F.when(F.col("failure"), _signatures(lines)),
            "approach": F.when(F.col("failure"), _approach(lines)),
            "fact": _fact(lines),
            "summary": command_summary(F.coalesce("command", F.lit(""))),
        }
    ).drop("_lines")


CAPS = {"tests_run": 20, "failing_signatures": 12, "failed_approaches": 12, "modified_files": 24, "decisions_made": 12}
STATE = "session long, tests_run array<string>, failing_signatures array<string>, failed_approaches array<string>, pinned_facts array<string>, decisions_made array<string>, modified_files array<string>, changes long"


class ToolState:
    """The state after a session's tool events so far; lists are capped, so it stays small."""

    def __init__(self):
        self.lists = {k: [] for k in ("tests_run", "failing_signatures", "failed_approaches", "pinned_facts", "decisions_made", "modified_files")}
        self.changes = 0

    def _add(self, name: str, value: str) -> None:
        if value not in self.lists[name]:
            self.lists[name].append(value)
            self.changes += 1

    def step(self, e) -> None:
        if e.tool == "Bash":
            self._add("tests_run", f"{e.summary} [{e.outcome}]")
            if e.failure:
                for s in e.signatures:
                    self._add("failing_signatures", s)
                if e.approach:
                    self._add("failed_approaches", e.approach)
            if e.fact:
                self._add("pinned_facts", e.fact)
            if e.success and (self.lists["failing_signatures"] or self.lists["failed_approaches"]):
                cleared = len(self.lists["failing_signatures"])
                self.lists["failing_signatures"].clear()
                self._add("decisions_made", f"Validated current approach with `{e.summary}` (after {cleared} failing)")
        elif e.tool in ("Edit", "Write") and e.path:
            self._add("modified_files", e.path.lstrip("/"))
        for name, most in CAPS.items():
            del self.lists[name][:-most]


def tool_states(events: DataFrame) -> DataFrame:
    """STATE per session after all its events in order of seq.

    The transition depends on the whole past, so it is Python; a task streams
    its sorted sessions and holds one capped state, whatever a session's length.
    """
    cols = ["session", "seq", "tool", "path", "failure", "success", "outcome", "signatures", "approach", "fact", "summary"]
    dealt = with_outcome(events).select(*cols).repartition("session").sortWithinPartitions("session", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, done = None, ToolState(), []
        row = lambda: {"session": now, **{k: list(v) for k, v in state.lists.items()}, "changes": state.changes}
        for frame in frames:
            for e in frame.itertuples(index=False):
                if now is not None and e.session != now:
                    done.append(row())
                    state = ToolState()
                now = e.session
                state.step(e)
            if done:
                yield pd.DataFrame(done)
                done = []
        if now is not None:
            yield pd.DataFrame([row()])

    return dealt.mapInPandas(run, STATE)


# -- restart packets


#: Sections of a packet in their order, and what may stay of each list.
SECTIONS = [
    ("session_objective", "OBJECTIVE"), ("current_subtask", "CURRENT SUBTASK"), ("decisions_made", "DECISIONS MADE"), ("failed_approaches", "FAILED APPROACHES TO AVOID"), ("failing_signatures", "CURRENT FAILING SIGNATURES"),
    ("modified_files", "MODIFIED FILES"), ("pending_next_actions", "NEXT ACTIONS"), ("pinned_facts", "PINNED FACTS"), ("hard_constraints", "CONSTRAINTS"), ("tests_run", "RECENT COMMANDS"), ("recent_turns", "RECENT TURNS"),
]
PACKET_KEEP = {"recent_turns": 6, "tests_run": 8, "failed_approaches": 8, "decisions_made": 8, "modified_files": 12, "pending_next_actions": 6}


# What makes an approach telling, and what each mark counts; over budget lists give way in the order turns, commands, approaches, decisions.
TELLING = [(2, ["error", "failed", "panic"]), (2, ["/", "::", ".rs", ".ts"]), (1, ["test", "build", "compiler"])]


def approach_value(item: Column) -> Column:
    """How telling a failed approach is; the least telling go first."""
    low = F.lower(item)
    return sum((F.when(T.contains_any(low, marks), points).otherwise(0) for points, marks in TELLING), F.lit(0))


_HEAD = "[restart packet]\n"


def render_packet(packet: dict[str, Column], lists: set[str]) -> Column:
    """The sections that have content, in their order; empty without any."""
    parts = []
    for name, title in SECTIONS:
        if name in lists:
            items = F.array_join(F.transform(packet[name], lambda x: F.concat(F.lit("- "), T.trim(x), F.lit("\n"))), "")
            parts.append(F.when(F.size(packet[name]) > 0, F.concat(F.lit(f"{title}\n"), items, F.lit("\n"))).otherwise(""))
        elif name in packet:
            parts.append(F.coalesce(F.concat(F.lit(f"{title}\n"), T.trim(packet[name]), F.lit("\n\n")), F.lit("")))
    body = F.concat(*parts)
    return F.when(body == "", "").otherwise(F.concat(F.lit(_HEAD), body))


_MEASURES = ["chars", "punct", "words", "lines", "digits", "marks"]


def _summed(items: Column) -> Column:
    """Measures added up."""
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in _MEASURES])
    return F.aggregate(items, none, lambda a, x: F.struct(*[(a[c] + x[c]).alias(c) for c in _MEASURES]))


def packets(states: DataFrame, max_tokens: int = 600) -> DataFrame:
    """(session, packet, tokens) of merged states: the first of a session's candidates that fits.

    Candidate i is the newest entries (PACKET_KEEP) less i evictions: the oldest
    turns, the oldest commands, the least telling approaches (the first of
    equals), then decisions down to one.  There are as many as the bounds of
    these lists, under 30; if none fits, the last stands.  Null lists and
    entries count as missing.

    Every line of a packet is measured once; a candidate's measures are the
    whole packet's less those of what went (with a list's last entry, its
    title), so only the chosen one is written out.
    """
    names = [n for n, _ in SECTIONS if n in states.columns]
    titles = dict(SECTIONS)
    lists = {n for n in names if states.schema[n].dataType.simpleString().startswith("array")}
    empty = F.array().cast("array<string>")
    whole = {n: F.array_compact(F.coalesce(F.col(n), empty)) if n in lists else F.col(n) for n in names}
    newest = lambda c, k: F.slice(c, F.greatest(F.size(c) - k + 1, F.lit(1)), k)
    kept = states.select("session", *[(newest(c, PACKET_KEEP[n]) if n in lists and n in PACKET_KEEP else c).alias(n) for n, c in whole.items()])
    giving = [n for n in ("recent_turns", "tests_run", "failed_approaches", "decisions_made") if n in lists]
    room = {n: F.greatest(F.size(n) - (1 if n == "decisions_made" else 0), F.lit(0)) for n in giving}
    if "failed_approaches" in giving:
        kept = kept.withColumn("_order", F.array_sort(F.transform("failed_approaches", lambda x, j: F.struct(approach_value(x).alias("value"), j.alias("at")))))

    line = lambda x: F.concat(F.lit("- "), T.trim(x), F.lit("\n"))
    frame = lambda n: tokens.measures(F.lit(f"{titles[n]}\n\n"))
    plus = lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in _MEASURES])
    measured = kept.withColumns({f"_{n}": F.transform(F.transform(n, line), tokens.measures) for n in lists})
    none = F.array().cast(f"array<struct<{','.join(f'{c}:bigint' for c in _MEASURES)}>>")
    parts = []
    for n in names:
        if n in lists:
            parts.append(F.when(F.size(n) > 0, F.concat(F.array(frame(n)), f"_{n}")).otherwise(none))
        else:
            scalar = tokens.measures(F.concat(F.lit(f"{titles[n]}\n"), T.trim(F.col(n)), F.lit("\n\n")))
            parts.append(F.when(F.col(n).isNotNull(), F.array(scalar)).otherwise(none))
    gone = []
    for n in giving:
        items = F.col(f"_{n}")
        if n == "failed_approaches":
            items = F.transform("_order", lambda o: F.element_at("_failed_approaches", o["at"] + 1))
        if n == "decisions_made":
            items = F.slice(items, F.lit(1), room[n])
        else:  # the last entry takes the title along
            last = F.array(plus(F.element_at(items, -1), frame(n)))
            items = F.when(F.size(n) == 0, none).otherwise(F.concat(F.slice(items, F.lit(1), F.size(n) - 1), last))
        gone.append(items)
    measured = measured.withColumns({"_all": _summed(F.concat(*parts)), **({"_gone": F.concat(*gone)} if gone else {})})
    head = tokens.measures(F.lit(_HEAD))
    cost = lambda m: F.when(m["chars"] == 0, F.lit(0)).otherwise(tokens.estimated_of(plus(m, head)))
    tried = measured.withColumn("_now", F.struct(F.col("_all").alias("m"), F.lit(0).alias("i"), cost(F.col("_all")).alias("tokens")))
    if gone:

        def step(now: Column, x: Column) -> Column:
            left = F.struct(*[(now["m"][c] - x[c]).alias(c) for c in _MEASURES])
            fits = now["tokens"] <= max_tokens
            return F.when(fits, now).otherwise(F.struct(left.alias("m"), (now["i"] + 1).alias("i"), cost(left).alias("tokens")))

        tried = tried.withColumn("_now", F.aggregate("_gone", F.col("_now"), step))
    tried = tried.select("session", *names, *(["_order"] if "failed_approaches" in giving else []), F.col("_now.i").alias("i"), F.col("_now.tokens").cast("long").alias("tokens"))

    taken, left = {}, F.col("i")
    for n in giving:
        taken[n] = F.least(left, room[n])
        left = F.greatest(left - room[n], F.lit(0))
    packet = {n: F.col(n) for n in names}
    for n in giving:
        packet[n] = F.slice(n, taken[n] + 1, F.greatest(F.size(n), F.lit(1)))
    if "failed_approaches" in taken:
        out = F.transform(F.slice("_order", F.lit(1), taken["failed_approaches"]), lambda x: x["at"])
        packet["failed_approaches"] = F.filter("failed_approaches", lambda x, j: ~F.array_contains(out, j))
    return tried.select("session", render_packet(packet, lists).alias("packet"), "tokens")


def latest(rows: DataFrame) -> DataFrame:
    """The newest state of each session."""
    w = Window.partitionBy("session").orderBy(F.desc("seq"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
