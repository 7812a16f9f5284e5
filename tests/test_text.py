"""Pinned text semantics and hand-made reductions."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import detect, tokens
from quillspark.functions import text as T
from quillspark.operators import reduce as R
from quillspark.operators import session as S


# -- the packet rules in plain Python


def estimate_tokens(text: str) -> int:
    """The token estimate of functions.tokens for one string, for loops that depend on it."""
    if not text:
        return 0
    lines = text.replace("\r\n", "\n").split("\n")
    n = max(1, len(lines) - (lines[-1] == ""))
    code = sum(c in tokens.PUNCTUATION for c in text) / len(text) > 0.11 or any(m in text for m in tokens.CODE_MARKS)
    est = 0.58 * (len(text) / (3.3 if code else 4.0)) + 0.42 * (len(re.findall(r"\S+", text)) * (1.45 if code else 1.28))
    est += sum("0" <= c <= "9" for c in text) * 0.02 + (min(n * 0.15, 24.0) if code else min(n * 0.05, 10.0))
    return max(1, math.floor(est + 0.5))


def render_packet(packet: dict) -> str:
    parts = []
    for name, title in S.SECTIONS:
        value = packet.get(name)
        if isinstance(value, str):
            parts.append(f"{title}\n{value.strip()}\n\n")
        elif value:
            parts.append(title + "\n" + "".join(f"- {x.strip()}\n" for x in value) + "\n")
    return "[restart packet]\n" + "".join(parts) if parts else ""


def approach_value(item: str) -> int:
    low = item.lower()
    return 2 * any(x in low for x in ("error", "failed", "panic")) + 2 * any(x in low for x in ("/", "::", ".rs", ".ts")) + any(x in low for x in ("test", "build", "compiler"))


def fit_packet(state: dict, max_tokens: int = 600) -> dict:
    """The packet of a state; over budget go the oldest turns, the oldest commands, the least telling approaches, then decisions down to one."""
    packet = {k: v if isinstance(v, str) or v is None else list(v)[-S.PACKET_KEEP[k] :] if k in S.PACKET_KEEP else list(v) for k, v in state.items()}
    while estimate_tokens(render_packet(packet)) > max_tokens:
        if packet.get("recent_turns"):
            packet["recent_turns"].pop(0)
        elif packet.get("tests_run"):
            packet["tests_run"].pop(0)
        elif packet.get("failed_approaches"):
            items = packet["failed_approaches"]
            items.pop(min(range(len(items)), key=lambda i: approach_value(items[i])))
        elif len(packet.get("decisions_made") or []) > 1:
            packet["decisions_made"].pop(0)
        else:
            break
    return packet


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("a\r\nb", ["a", "b"]), ("\n", [""])])
def test_lines(spark, text, want):
    assert one(spark, T.lines(F.col("t")), t=text) == want


def test_trim_is_unicode(spark):
    assert one(spark, T.trim(F.col("t")), t="　 a ") == "a"


@pytest.mark.parametrize("text,want", [("123", True), ("", False), ('{"a": 1}', True), ("2 errors\nhere", False), ("1, 2", False), ("null", True), ("[1], [2]", False)])
def test_strict_json(spark, text, want):
    assert one(spark, detect.is_json(F.col("t")), t=text) is want


def test_estimate_of_empty_and_python_twin(spark):
    assert one(spark, tokens.estimated(F.col("t")), t="") == 0
    for text in ("a", "fn main() { let x = 1; }\n" * 9, "word " * 300, "Ünïcode — 12 345\n"):
        assert one(spark, tokens.estimated(F.col("t")), t=text) == estimate_tokens(text)


def reduced(spark, reducer, text):
    return reducer(spark.createDataFrame([(1, text)], "id long, text string")).first()["reduced"]


def test_stack_trace_runs(spark):
    text = "Error: x\n at a (node:1)\n at a (node:1)\n at b (node:2)\n at c (node:3)\nuser\nuser"
    got = reduced(spark, R.stack_trace, text).split("\n")
    assert got[:4] == ["Error: x", " at a (node:1)", "[condensed] collapsed 1 duplicate stack lines", "[condensed] collapsed 2 internal runtime frames"]
    assert got[4:6] == ["user", "[condensed] collapsed 1 duplicate stack lines"]


def test_test_log_keeps_failures(spark):
    text = "\n".join(["$ npm test", *[f"PASS src/file_{i}.test.ts" for i in range(30)], "FAIL src/b.test.ts", "  some context", "", "PASS z", "noise", "Tests: 1 failed"])
    got = reduced(spark, R.test_log, text)
    assert "FAIL src/b.test.ts\n  some context\n\n" in got and "noise" not in got and "31 tests passed" in got


def test_lint_groups_rules(spark):
    text = "".join(f"warning[r::a]: bad thing number\n  --> src/x.rs:{i}:1\n  | some source line here\n" for i in range(1, 6)) + "error[E1]: boom\n"
    got = reduced(spark, R.lint_output, text)
    assert got.startswith("error[E1]: boom\nwarning[r::a]") and "4 more: src/x.rs:2:1, src/x.rs:3:1, src/x.rs:4:1, src/x.rs:5:1 (collapsed)" in got


def test_config_keeps_marked_comments(spark):
    text = "[a]\n" + "# a plain comment that says nothing at all of use\n" * 9 + "# TODO keep\n; see v1.2\nx = 1\n"
    got = reduced(spark, R.config, text)
    assert "plain" not in got and "# TODO keep" in got and "; see v1.2" in got


@pytest.mark.parametrize("text,want", [("1 failed", False), ("Tests: 1 failed", True), ("0 failed", False), ("error: x", True), ("FAIL a", True), ("ok", False)])
def test_failure_marks(spark, text, want):
    assert one(spark, S.is_failure(F.col("t")), t=text) is want


@pytest.mark.parametrize("command,want", [("cd /a && FOO='x y' cargo test", "cargo test"), ("env A=1 timeout 5 npm test", "npm test"), ("timeout x go test", "timeout x go test"), ('B="a\\"b" ls', "ls")])
def test_core_command(spark, command, want):
    assert one(spark, S.core_command(F.col("t")), t=command) == want


def packed(spark, states, most):
    kinds = {n: "string" if isinstance(v, str) else "array<string>" for s in states for n, v in s.items() if v is not None}
    df = spark.createDataFrame([(i, *[s.get(n) for n in kinds]) for i, s in enumerate(states)], "session long, " + ", ".join(f"{n} {k}" for n, k in kinds.items()))
    return {r.session: (r.packet, r.tokens) for r in S.packets(df, most).collect()}


def test_packet_budget(spark):
    state = {"session_objective": "Ship", "recent_turns": [f"turn {i} " + "word " * 30 for i in range(9)], "tests_run": ["cargo test"], "failed_approaches": ["tried x", "error in src/a.rs"], "decisions_made": ["d1", "d2"]}
    packet, n = packed(spark, [state], 60)[0]
    assert "turn" not in packet and "d2" in packet and n <= 60


def test_packets_equal_the_loop(spark):
    """States of all sizes against eviction one by one, at budgets from none to plenty."""
    rnd = random.Random(3)
    item = lambda: rnd.choice(["tried", "error in src/a.rs", "test failed", "build x::y", " panic  ", "word " * rnd.randint(1, 9)])
    states = [{"session_objective": rnd.choice([None, "", "Ship it"]), **{n: rnd.choice([None, [item() for _ in range(rnd.randint(0, 14))]]) for n, _ in S.SECTIONS if n not in ("session_objective", "current_subtask")}} for _ in range(40)] + [{}]
    for most in (0, 40, 120, 300, 10_000):
        got = packed(spark, states, most)
        for i, state in enumerate(states):
            want = render_packet(fit_packet({n: state.get(n) or (None if n == "session_objective" and state.get(n) is None else state.get(n)) for n, _ in S.SECTIONS}, most))
            assert got[i] == (want, estimate_tokens(want)), (i, most)


def test_tool_state_machine(spark):
    rows = [(1, 1, "Bash", "cargo test", None, "error: a\ntest x::y ... FAILED"), (1, 2, "Bash", "cargo test", None, "test result: ok. 1 passed"), (1, 3, "Edit", None, "/src/a.rs", None), (2, 1, "Bash", None, None, "")]
    got = {r.session: r for r in S.tool_states(spark.createDataFrame(rows, "session long, seq long, tool string, command string, path string, output string")).collect()}
    assert got[1].failing_signatures == [] and got[1].failed_approaches == ["error: a"] and len(got[1].decisions_made) == 1 and got[1].modified_files == ["src/a.rs"]
    assert got[2].tests_run == ["a tool action [observed]"]


def test_config_overlay():
    from quillspark.plans.engine import Config

    base, over = Config(mode="aggressive", include_paths=("a", "b")), Config(include_paths=("b", "c"))
    assert base.merged(over) == Config(include_paths=("a", "b", "c"))
    with pytest.raises(ValueError):
        Config(retain_days=0).validated()


def test_config_scores_use_parsers(spark):
    from quillspark.plans import engine

    texts = ["[a]\nx = 1\n", "a: 1\nb: [2, 3]\n", "x = = 1\ny = [\nz: }", "plain words", "Error: x\n at a\n at b\nc: d\ne: f"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: round(r.s, 2) for r in df.select("id", engine.config_score(F.col("text")).alias("s")).collect()}
    assert got == {0: 0.9, 1: 0.7, 2: 0.7, 3: 0.0, 4: 0.0}


def test_pipe_only_shrinks(spark):
    from quillspark.plans import engine

    log = "$ npm test\n" + "\n".join(f"PASS src/long/path/to/test_{i}.ts" for i in range(40)) + "\nTest Suites: 40 passed"
    got = {r.id: r for r in engine.pipe(spark.createDataFrame([(1, log), (2, "hello")], "id long, text string")).collect()}
    assert got[1].kind == "test_log" and len(got[1].output) < len(log) and got[2].output == "hello" and got[2].kind is None


def test_payloads_that_are_no_text_pass_through(spark):
    from quillspark.plans import engine

    log = "\n".join(["Error: x", *["    at f (a.ts:1:2)"] * 40]).encode()
    rows = [(1, log), (2, log + b"\xff\xfe"), (3, b""), (4, None), (5, b"\x80")]
    got = {r.id: r for r in engine.pipe_payloads(spark.createDataFrame(rows, "id long, payload binary")).collect()}
    assert {i: r.output for i, r in got.items() if i > 1} == dict(rows[1:]) and all(got[i].kind is None for i in (2, 3, 4, 5))
    assert got[1].kind == "stack_trace" and len(got[1].output) < len(log)
