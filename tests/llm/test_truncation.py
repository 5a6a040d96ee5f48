"""Truncation: the automaton, the evidence, and accuracy on documents whose pages are known."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemill.llm import truncation as tr

DATA = "/root/testdata/sf0.01"


def test_automaton():
    cases = {
        "a (b [c] d) e": ([], []), "a (b [c": (["(", "["], []), "“a „b“": (["“"], []), "“a”": ([], []), "said „so“ (": (["("], []), "a <b>x</b>": ([], []), "a <b>x": (["<b"], []), "1 < 2": ([], []),
        "a) b]": ([], []), "(lost\nnext": ([], ["("]), "(lost\nnext (": (["("], ["("]), "(over\ntwo lines)": ([], []), "«a» «b": (["«"], []), "": ([], []), 'say "so" and "no': (['"'], []), 'a 5" pipe': ([], []),
        '"on\ntwo lines"': ([], []), "<div>\n<b>x</b>\n": ([], ["<div"]), "<p>one<br>two": ([], []), "(<b>x)</b>": (["("], []), "f(1, \"x\")": ([], []),
    }
    for text, still in cases.items():
        assert tr.open_at_end(text) == still, text


@pytest.mark.parametrize(
    "text,cause",
    [
        ("words <im", "markup"), ("words </", "markup"), ("words <", "markup"), ("a < b", None), ("x <y and z", None), ('x <a href="b" tit', "markup"), ("x <a\nhref='b c", "markup"), ("x <!-- rem", "markup"), ("<b>x</b>", None), ("words &am", "entity"), ("x&#82", "entity"), ("x&", "entity"), ("R &", None), ("x &amp;", None), ("AT&T", None),
        ("a%C3%A", "escape"), ("a 50%", None), ("a\\u00", "escape"), ("caf�", "bytes"), ("caf�s", None), ("na�ve caf�", None), ("it. �", "bytes"), ("end.�", None), ("Ã¶ffnen Ã", "bytes"), ("plain", None),
    ],
)
def test_tails(text, cause):
    assert tr.broken_tail(text) == cause


def test_pages():
    page = "<!doctype html><html><head><title>T</title></head><body>\n<p>One two three four five six.</p>\n<p>Seven eight nine ten eleven</p>\n</body></html>\n"
    state = lambda text, p: tr.page_state(text, p.encode())
    assert state("One two three four five six.\nSeven eight nine ten eleven", page) == "whole"
    assert state("One two three four five six.\nSeven ei", page) == "goes_on"
    half = page[: page.index("ine ten")]
    assert state("One two three four five six.\nSeven eight n", half) == "broken"
    assert state("One two three four five six.\nSeven eight n<im", half) == "broken"
    assert state("One two three four five six.", half) is None
    assert state("Something else altogether, it seems", page) is None
    assert state("Some words in the page here", "<html><!-- <b> --><p>Some words in the page here</p><!----></html>") == "whole"
    assert tr.page_state("text without a page here", None) is None and state("plain text served as it is", "plain text served as it is") is None
    assert state("日本語の長い文章がここにあります", "<html><body><p>日本語の長い文章がここにあります</p></body></html>") == "whole"
    assert tr.page_state("d'été à la plage toujours", "<html><body><p>d'été à la plage toujours</p></body></html>".encode("latin-1")) == "whole"


def test_examine():
    got = tr.examine("Full sentence. Another one", None, "HTTP/1.1 200 OK\r\nContent-Length: 400\r\nContent-Encoding: gzip\r\n")
    assert got == (26, 26, 1, 0, "sentence", None, 400, True)
    assert tr.examine("Home | Shop | News", None, "broken headers\x00")[3:] == (0, "line", None, None, False) and tr.examine("1 < 2 & 3 > 2", None, None)[3] == 10


@pytest.mark.parametrize(
    "text,state",
    [
        ("Full sentence here. Another one goes on and", "sentence"), ("It ends. ", "ended"), ("It goes on ", "space"), ("It (was. “So", "quote"), ("It was (so", "bracket"), ("   ", "blank"), ("More to come...", "ellipsis"),
        ("x" * 3_000_000 + " (", "bracket"), ("A heading", "line"), ("(lost\na heading", "left"), ("it was red, green, blue,", "clause"), ("Red, green,", "line"), ("so <b>it is", "element"), ("He said. “It was.”", "ended"), ("He said. “It was”", "sentence"),
        ("1) First. And then it goes on", "line"), ("https://a.example/b.html?c d e f", "line"), ("wrong quote.â€\ufffd", "ended"), ("caf\ufffd", "bytes"),
        ("今日は雨が降っています。明日は山へ", "sentence"), ("今日は雨が降っています。明日は晴れます。", "ended"), ("雨。山", "line"), ("日本語の見出し", "line"),
    ],
)
def test_end_states(text, state):
    assert tr.end_state(text) == state and (state in tr.OPEN) != (state in tr.CLOSED)


def test_corner_quotes():
    assert [tr.open_at_end(t)[0] for t in ("彼は「今日は『雨』だ」と言った", "彼は「今日は『雨", "彼は「今日は『雨』だ")] == [[], ["「", "『"], ["「"]]


def test_long_texts_take_time_in_proportion():
    """Shapes that make a careless scan quadratic, a million characters each."""
    n = 250_000
    shapes = ["[<b>" + "(" * n + "]" * n, "(" * n + '"' * n, "<!--" * n, "<a b=c " * n, "<i>" * n + "</b>" * n, "&" * n, "「" * n + "』" * n, "<" * n, "%41" * n, "a. b" * n, "<a" + " b=c" * n, "| " * n]
    began = time.perf_counter()
    for shape in shapes:
        tr.examine(shape, shape.encode(), "x" * n)
    assert time.perf_counter() - began < 60


def test_mixture():
    """Of 1,000 cut texts among 20,000 a tenth is torn; half of all promise nothing, of the cut others nine in ten promise more than 99.9 % of the whole."""
    def split(n, far):
        return [("plain 8 8", n * far // 2), ("plain 0 8", n * (1 - far) // 2), ("none", n / 2)]

    cells = [("markup", h, n) for h, n in split(100, 0.9)] + [("ended", h, n) for h, n in split(12_000, 0.001)]
    cells += [("sentence", a, n + m) for (a, n), (_, m) in zip(split(600, 0.9), split(400, 0.001))] + [("line", a, n + m) for (a, n), (_, m) in zip(split(300, 0.9), split(6600, 0.001))]
    share, by_state, by_level = tr.mixture(cells)
    assert abs(share - 0.05) < 0.01 and by_state["ended"] == by_state["ellipsis"] == 0.0 and by_level["none"] == 1.0
    assert by_state["markup"] > 1000 and abs(by_state["sentence"] - 0.6 / (400 / 19_000)) < 6 and by_state["line"] < 1.2 and by_level["plain 8 8"] > 500 and by_level["plain 0 8"] < 1
    assert tr.mixture([])[0] < 1


SCHEMA = "doc_id long, text string, source string, headers string, raw_bytes binary, cause string, s string"


def prose(rng, n):
    out = ""
    while len(out) < n:
        out += " ".join(rng.choice(["alder", "birch", "cedar", "elm", "fir", "oak", "pine", "yew"]) + str(rng.randrange(99)) for _ in range(9)) + rng.choice([". ", ".\n"])
    return out


def make(seed=1, n=900):
    """Three sources: one cuts at 700 characters, one back to a word below 900, one not at all."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = ["cut", "back", "free"][i % 3]
        text = prose(rng, rng.randrange(300, 1500)).rstrip()
        whole = text
        if source == "cut":
            text = text[:700]
        elif source == "back" and len(text) > 900:
            text = text[:900].rsplit(" ", 1)[0]
        rows.append((i, text, source, None, None, "x", "y", whole != text))
    return rows


def test_limits_are_found(spark):
    rows = make()
    df = spark.createDataFrame([r[:7] for r in rows], SCHEMA)
    got = {r.doc_id: r.cause for r in tr.truncated(df).collect()}
    cut = {r[0] for r in rows if r[7] and not r[1].rstrip().endswith(".")}
    assert {i for i, c in got.items() if c} == cut and {got[i] for i in cut} <= {"sentence", "space", "line"}
    limits = {(r.source, r.unit, r.length) for r in tr.limits(tr.features(df)).where("exact").collect()}
    assert {("cut", "chars", 700), (tr.NO_SOURCE, "chars", 700)} <= limits and not [x for x in limits if x[0] == "free"]
    rates = {r.source: r for r in tr.rates(tr.truncated(df)).collect()}
    assert rates["free"].n_truncated == 0 and rates["cut"].n == 300 and rates["cut"].n_limit == rates["cut"].n_truncated and rates["cut"].rate == rates["cut"].n_truncated / 300


def test_short_limits_are_found(spark):
    """Limits below 100 characters, and texts a little above it that end alike but are not the same."""
    rng = random.Random(3)
    whole = [prose(rng, rng.randrange(40, 400)).rstrip() for _ in range(400)]
    rows = [(i, t[: (64, 110)[i % 2]], ("short", "mid")[i % 2], None, None, "x", "y") for i, t in enumerate(whole)]
    rows += [(1000 + i, f"{prose(rng, 96)[:96]} and so on", "alike", None, None, "x", "y") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = tr.features(df)
    assert seen.where("source = 'alike'").select("same").distinct().count() == 30
    limits = {(r.source, r.length) for r in tr.limits(seen).where("exact AND unit = 'chars'").collect()}
    assert {("short", 64), ("mid", 110)} <= limits


def test_documents_of_every_kind(spark):
    rows = [(1, None, "a", None, None), (2, "", "a", "x", b"y"), (3, "lost (in", None, None, None), (3, "lost (in", None, None, None), (4, "fine.", None, None, b""), (5, "x" * 2_000_000, "a", None, b"\xff\xfe"), (6, "cut at a <im", "a", "Content-Length: 99999999999999999999", None), (7, "\n", "b", None, None), (8, "fine.", "b", None, None)] + [(100 + i, "fine.", "b", None, None) for i in range(9)]
    df = spark.createDataFrame([(*r, "c", "s") for r in rows], SCHEMA)
    got = sorted((r.doc_id, r.cause) for r in tr.truncated(df).collect() if r.cause)
    assert got == [(3, "bracket"), (3, "bracket"), (6, "markup")]
    assert tr.truncated(df.limit(0)).count() == 0 and tr.rates(tr.truncated(df.limit(0))).count() == 0


def test_headers_count_against_the_source(spark):
    """A text in the middle of a sentence counts where its headers promise more than the source's ended texts need, not where its source has such pages anyway."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        text, source = prose(rng, rng.randrange(200, 900)).rstrip(), ("narrow", "wide")[i % 2]
        around = rng.randrange(100, 140) if source == "narrow" else rng.randrange(100, 1500)
        whole, kind = len(text), i % 20
        if kind == 0:
            text = text[: len(text) // 2] + " <im"
        elif kind in (2, 3):
            text = text[: len(text) // 2].rsplit(" ", 1)[0]
        rows.append((i, text, source, f"Content-Length: {whole + around}", None, "x", "y", kind))
    df = spark.createDataFrame([r[:7] for r in rows], SCHEMA)
    got = {r.doc_id: r.truncated for r in tr.truncated(df).collect()}
    open_ = {r[0] for r in rows if r[7] in (2, 3) and tr.end_state(r[1]) in ("sentence", "line")}
    assert all(got[r[0]] for r in rows if r[7] == 0) and not any(got[r[0]] for r in rows if r[7] > 3)
    narrow = [got[i] for i in open_ if i % 2 == 0]
    assert sum(narrow) / len(narrow) > 0.9


def test_without_the_automaton_nothing_is_found(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = tr.features(docs).withColumn("state", F.lit("ended"))
    monkeypatch.setattr(tr, "features", lambda _: seen)
    assert tr.truncated(docs).where("truncated").count() == 0


def test_accuracy_without_pages(spark):
    """Judge documents of a known page with the page held back, against what the page says. The README has the figures of larger tables."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    truth = tr.features(docs).where(F.col("page").isNotNull()).select("doc_id", F.col("page").isin("goes_on", "broken").alias("real"))
    found = tr.truncated(docs.withColumn("raw_bytes", F.lit(None).cast("binary"))).select("doc_id", "truncated")
    n = {(r.real, r.truncated): r["count"] for r in truth.join(found, "doc_id").groupBy("real", "truncated").count().collect()}
    hits, misses, wrong = n.get((True, True), 0), n.get((True, False), 0), n.get((False, True), 0)
    assert hits / (hits + wrong) > 0.9 and hits / (hits + misses) > 0.8
