"""Texts that lost their end to a length limit or a broken transfer.

*The stack automaton decides.* It runs over the whole text: quotes, brackets and elements are pushed and popped across lines, and
its end state says what the text leaves open – half a tag, entity, escape or multibyte sequence, a quote, a bracket, an element, a sentence,
a clause – or that a terminator closed it. A text with nothing open is never reported.

*The source's baseline weighs.* Whole texts miss a terminator too (headings, menus, code). So each end state counts by how much more often
cut texts have it than whole ones, and by how often the source cuts, both estimated from all documents, without labels: a text ended by
a terminator stands for the whole ones, and the mixture of both kinds is solved by expectation maximisation, on counts.

*Other evidence corroborates.* Lengths at which a source's unended texts pile up (limits in characters or bytes), headers that promise more than the source's ended texts
need, and the page, where it is there: a whole page that goes on, or one whose own elements are left open at the same place.
A text known to be all of its page is no case, however it ends.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.runtime import cut, ship

NO_SOURCE = "\0"

FEATURES = "n_chars long, n_bytes long, n_lines long, escaped long, state string, page string, promised long, zipped boolean"
#: End states of the automaton that leave something open, and those that do not.
OPEN = ("markup", "entity", "escape", "bytes", "quote", "bracket", "element", "space", "sentence", "clause", "left", "line")
CLOSED = ("ended", "ellipsis", "blank")
#: States in which whole texts hardly ever end.
TORN = ("markup", "entity", "escape", "bytes", "quote", "bracket")
#: States that headers which promise no more do not clear.
BARE = (*TORN, "space")
#: Probability from which a text counts as truncated.
SURE = 0.6
#: Lengths around a limit it is compared with; logarithm of how much rarer than once per source a chance limit may be.
AROUND, CERTAIN = 100, 9.2
#: Limits that cut back to a word leave most lengths in a stretch below the limit, of about two words, and a few in the next word's length.
STRETCH, FEW = 12, 5
#: Quantiles of the surplus of ended texts that part its levels.
LEVELS = [0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999]
#: Probability that a torn text is cut, to begin with and where no headers tell.
SEED = 0.95
SALTS = 16

_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“ „", "»": "«", "“": "„", "」": "「", "』": "『"}
_OPENERS = set("([{“„«「『")
_QUOTES = set('"“„«「『')
_STRUCTURE = re.compile(r"""[()\[\]{}“”„«»「」『』"\n]|<(?=[a-zA-Z/!?])[^<>]*>""")
_SENTENCE_END = re.compile(r"[.!?。！？][\"'”’»)\]）」』]*\Z")
_ELLIPSIS = re.compile(r"(?:…|\.\.\.)\Z")
_CLAUSE = re.compile(r"[,،、，]\Z")
_INSIDE = re.compile(r"[.!?。！？][\"'”’»)\]）」』]* ?\S")
#: Lines that are no prose: addresses, imprints, list items and menus.
_LISTED = re.compile(r"\W*(?:https?://|©|\d+[.)] )|[-*•·#] |.* \| ")
#: Letters of scripts written without spaces, of which about two make a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Words a line has at least that counts as prose.
_PROSE = 4
#: A tag that never closes: a name, whole attributes, and one begun.
_HALF_TAG = re.compile(r"""<(?:[!/?]?\Z|!-.*\Z|[!/?]?[a-zA-Z][\w:-]*(?:\s+[\w:-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))*(?:\s+(?:[\w:-]+\s*(?:=\s*(?:"[^"]*|'[^']*|[^\s"'<>]*))?)?)?\Z)""", re.S)
#: A closing quote decoded as Windows-1252, which has no character for its last byte.
_WRONG_QUOTE = "â€\ufffd"
_ENTITY = re.compile(r"&(#x?[0-9a-fA-F]*|[A-Za-z][A-Za-z0-9]*)?\Z")
_ESCAPE = re.compile(r"(?:\\u[0-9a-fA-F]{0,3}|%[0-9a-fA-F]{2}%[0-9a-fA-F]?)\Z")
_LENGTH = re.compile(r"^content-length:\s*(\d{1,18})\s*$", re.I | re.M)
_ZIPPED = re.compile(r"^content-encoding:\s*(?:gzip|deflate|br|zstd)", re.I | re.M)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^<>]*>")
#: fixed values: elements that need no end tag
_VOID = set("area base br col embed hr img input link meta source track wbr p li td tr th dd dt option".split())
_ASCII = re.compile(r"[^0-9A-Za-z]+")
#: Letters and digits that tell one place of a page from another.
KEY = 14


@lru_cache(maxsize=1)
def _entity_starts() -> frozenset[str]:
    """Beginnings of at least two letters of the lower-case names of character references."""
    names = [n.rstrip(";") for n in html.entities.html5 if n[0].islower()]
    return frozenset(n[:i] for n in names for i in range(2, len(n) + 1))


def open_at_end(text: str) -> tuple[list[str], list[str]]:
    """Run the stack automaton: what is open at the end of the text, opened on its last line and opened earlier.

    A closer takes its opener off the stack with what was left open inside it; one that has no opener is passed over. A straight
    quote closes an open one, else opens where a word may begin. Elements are pushed by start tags and popped by their end tags.
    """
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = defaultdict(list)  # of every symbol, and of elements under ``<``, in the stack
    line = 0

    def push(symbol: str) -> None:
        for key in (symbol, "<") if len(symbol) > 1 else (symbol,):
            places[key].append(len(stack))
        stack.append((symbol, line))

    def close(wanted: str) -> bool:
        at = max((places[w][-1] for w in wanted.split(" ") if places[w]), default=-1)
        # A bracket or quote does not close across an element left open inside it.
        if at < 0 or (len(stack[at][0]) == 1 and places["<"] and places["<"][-1] > at):
            return False
        for symbol, _ in stack[at:]:
            places[symbol].pop()
            if len(symbol) > 1:
                places["<"].pop()
        del stack[at:]
        return True

    for found in _STRUCTURE.finditer(text):
        token = found[0]
        if token == "\n":
            line += 1
        elif token == '"':
            if not close('"') and (found.start() == 0 or not (text[found.start() - 1].isalnum() or text[found.start() - 1] in ".,!?;:")):
                push(token)
        elif token[0] == "<":
            tag = _TAG.match(token)
            name = tag and (tag[2] or "").lower()
            if name and name not in _VOID and not token.endswith("/>"):
                if tag[1]:
                    close(f"<{name}")
                else:
                    push(f"<{name}")
        elif not (token in _PAIRS and close(_PAIRS[token])) and token in _OPENERS:
            push(token)
    return [s for s, at in stack if at == line], [s for s, at in stack if at < line]


def broken_tail(text: str) -> str | None:
    """What is broken off in the last characters: ``markup``, ``entity``, ``escape`` or ``bytes``."""
    tag = text.rfind("<")
    if tag >= 0 and _HALF_TAG.match(text, tag):
        return "markup"
    entity = _ENTITY.search(text, max(0, len(text) - 40))  # no name is longer
    if entity and (entity[1] is None or entity[1][:1] == "#" or entity[1] in _entity_starts()) and text[-2:-1] != " ":
        return "entity"
    if _ESCAPE.search(text, max(0, len(text) - 6)):
        return "escape"
    if text[-1] == "�":
        # Wrongly decoded texts hold such characters everywhere, and may end in one that was a closing quote.
        if text.find("�") == len(text) - 1 and not _SENTENCE_END.search(text[:-1]):
            return "bytes"
    elif text[-1] in "ÂÃâ" and re.search("[ÂÃ][\u0080-¿]", text):
        return "bytes"
    return None


def end_state(text: str) -> str:
    """The automaton's end state, one of ``OPEN`` or ``CLOSED``."""
    bare = text.rstrip()
    if not bare:
        return "blank"
    if bare.endswith(_WRONG_QUOTE):
        bare = bare[: -len(_WRONG_QUOTE)] + "”"
    broken = broken_tail(bare)
    if broken:
        return broken
    if _ELLIPSIS.search(bare):
        return "ellipsis"
    if _SENTENCE_END.search(bare):
        return "ended"
    here, earlier = open_at_end(bare)
    signs = {s for s in here if len(s) == 1}
    if signs:
        return "quote" if signs & _QUOTES else "bracket"
    if here:
        return "element"
    if text[-1].isspace():
        return "space"
    last = bare[bare.rfind("\n") + 1 :]
    words = last.count(" ") + 1 + len(_UNSPACED.findall(last)) // 2
    prose = words >= _PROSE and not _LISTED.match(last)
    if prose and _INSIDE.search(last):
        return "sentence"
    if prose and _CLAUSE.search(last):
        return "clause"
    return "left" if earlier else "line"


def _uncommented(page: str) -> str:
    """The page without its comments; one that never ends is kept."""
    out, at = [], 0
    while (begin := page.find("<!--", at)) >= 0 and (end := page.find("-->", begin + 4)) >= 0:
        out.append(page[at:begin])
        at = end + 3
    return "".join([*out, page[at:]])


def page_state(text: str, page: bytes | None) -> str | None:
    """Where the text ends in the page it is from.

    ``whole``: at the end of a whole page; ``goes_on``: a whole page goes on after it; ``broken``: both end at the same place, the page with
    its markup open; NULL: no page, no markup to judge by, or the text's end isn't found.
    """
    if not page:
        return None
    try:
        source = page.decode("utf-8")
    except UnicodeDecodeError:
        source = page.decode("utf-8", errors="ignore") if page[:-4].decode("utf-8", errors="ignore").encode() in (page[:-4], page[:-5], page[:-6], page[:-7]) else page.decode("latin-1")
    stack: list[str] = []
    inside: Counter[str] = Counter()
    for found in _TAG.finditer(_uncommented(source)):
        name = found[2].lower()
        if name in _VOID or found[0].endswith("/>"):
            continue
        if not found[1]:
            stack.append(name)
            inside[name] += 1
        elif inside[name]:
            while inside[name] and (last := stack.pop()):
                inside[last] -= 1
                if last == name:
                    break
    if not stack and "<" not in source:
        return None
    closed = not stack
    letters = lambda s: _ASCII.sub("", s)
    bare = text.rstrip()
    tail = bare[-20 * KEY :]
    if len(letters(tail)) < KEY or len(letters(tail[-4 * KEY :])) < KEY // 2:
        # Little ASCII: compare the letters themselves.
        letters = lambda s: "".join(c for c in s if c.isalnum())
        if len(letters(tail)) < KEY // 2:
            return None
    plain = lambda s: letters(html.unescape(re.sub(r"<[^<>]*>?", " ", s)))
    body = plain(source)
    # The whole last line tells a place best; what the page writes otherwise may leave only its last letters.
    for key in (letters(bare[bare.rfind("\n") + 1 :]), letters(tail)[-KEY:]):
        at = body.rfind(key) if len(key) >= KEY // 2 else -1
        if at >= 0:
            break
    else:
        # A broken tag or entity at the end of the text is not in the page's letters.
        rest = plain(re.sub(r"(?:<[^<>\n]*|&[#A-Za-z0-9]*|\ufffd)\Z", "", tail))[-KEY:]
        return "broken" if not closed and len(rest) == KEY and body.endswith(rest) else None
    if closed:
        return "whole" if at + len(key) == len(body) else "goes_on"
    return "broken" if at + len(key) == len(body) else None


def examine(text: str, page: bytes | None, headers: str | None) -> tuple:
    """The features of one document, see ``FEATURES``; ``text`` is not empty.

    ``escaped`` is what a page writes more for the text's <, > and &. Where a text ends in its page is only asked of texts that may be truncated.
    """
    state = end_state(text)
    escaped = 3 * (text.count("<") + text.count(">")) + 4 * text.count("&")
    place = page_state(text, page) if page and (state in OPEN or state == "ellipsis") else None
    length = _LENGTH.search(headers.replace("\r", "")) if headers else None
    zipped = bool(headers and _ZIPPED.search(headers))
    return (len(text), len(text.encode("utf-8", "surrogatepass")), text.count("\n") + 1, escaped, state, place, int(length[1]) if length else None, zipped)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, source, same`` and the features of every document with text, in one pass of Arrow batches.

    ``same`` tells mirrored copies: texts that agree shortly before their end have one.
    """
    ship(docs.sparkSession)
    columns = [f.split(" ")[0] for f in FEATURES.split(", ")]

    @F.pandas_udf(f"struct<{FEATURES.replace(' ', ': ').replace(',:', ',')}>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [examine(t, None if p is None else bytes(p), h) for t, p, h in zip(batch["text"], batch["page"], batch["headers"])]
            yield pd.DataFrame(rows, columns=columns).astype({"promised": "Int64"})

    text = F.col("text")
    same = F.xxhash64(F.when(F.length(text) <= 120, text).otherwise(F.substring(text, F.length(text) - 120, 60))).alias("same")
    # Pages of texts that plainly end with a terminator stay in the JVM.
    tail = F.rtrim(F.right(text, F.lit(40)))
    page = F.when(~tail.rlike(r"(?<!\.\.)[.!?。！？][\"'”’»)\]）」』]*\z") | F.contains(text, F.lit("<")), F.col("raw_bytes"))
    given = docs.where(F.length(text) > 0).select("doc_id", "source", same, F.struct("text", page.alias("page"), "headers").alias("d"))
    return given.withColumn("f", run("d")).select("doc_id", "source", "same", "f.*")


def limits(seen: DataFrame) -> DataFrame:
    """``source, unit, length, exact``: the lengths that are at, or just below, a limit its source cuts texts at.

    What counts are texts without a terminator: a limit is a length that has so many more of them than the lengths around it that chance does not
    explain it anywhere in the source, of which at least ``SURE`` are then cut ones, and more often unended than
    the source's texts are. Or, for limits that cut back to a word, a stretch of lengths of which the same holds, next to no text being longer. The counts per
    source, unit and length are aggregated before the shuffle. ``NO_SOURCE`` has the exact limits of all sources, for documents without one.
    """
    unit = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(f"n_{u}").alias("length")) for u in ("chars", "bytes")]))
    tall = seen.where(F.col("source").isNotNull()).select("source", "same", (~F.col("state").isin("ended", "blank")).alias("unended"), unit.alias("u"))
    once = tall.groupBy("source", "u.unit", "u.length", "same").agg(F.max("unended").alias("unended"))
    counts = once.groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("unended").cast("bigint")).alias("m"))
    all_ = Window.partitionBy("source", "unit")
    of = all_.orderBy("length")
    near = lambda a, b, what="m": F.coalesce(F.sum(what).over(of.rangeBetween(a, b)), F.lit(0))
    length = F.col("length")
    # How many unended texts a length has by chance: as the lengths around it, near and wide; below a short length there are fewer.
    by_chance = lambda reach: (near(-reach, -4) + near(4, reach) + 0.5) / (F.least(length, F.lit(reach)) + reach - 6)
    wide = counts.withColumns({
        "chance": F.greatest(by_chance(AROUND), by_chance(AROUND // 10)),
        "stretch": near(-(STRETCH - 1), 0), "stretch_n": near(-(STRETCH - 1), 0, "n"), "over": near(1, AROUND, "n"),
        "stretch_chance": STRETCH * (near(-AROUND - STRETCH, -STRETCH) + 0.5) / F.greatest(F.least(length - STRETCH, F.lit(AROUND)), F.lit(1)),
        "usual": F.sum("m").over(all_) / F.sum("n").over(all_), "lengths": F.count(F.lit(1)).over(all_),
    })

    def stands_out(m: Column, n: Column, chance: Column) -> Column:
        surprise = m * F.log(m / chance) - (m - chance)
        return (m * (1 - SURE) >= chance) & (surprise > F.log("lengths") + CERTAIN) & (m / n > F.col("usual"))

    spike = stands_out(F.col("m"), F.col("n"), F.col("chance"))
    back = stands_out(F.col("stretch"), F.col("stretch_n"), F.col("stretch_chance")) & (F.col("over") * 20 <= F.col("stretch_n"))
    spread = lambda a, b, exact: F.explode(F.array(*[F.struct((length + i).alias("length"), F.lit(exact and i == 0).alias("exact")) for i in range(a, b)])).alias("l")
    exact = wide.where(spike).select("source", "unit", spread(-3, 4, True))
    words = wide.where(back & ~spike).select("source", "unit", spread(1 - STRETCH - FEW, 1, False))
    marks = cut(exact.unionByName(words).groupBy("source", "unit", "l.length").agg(F.max("l.exact").alias("exact")))
    return marks.unionByName(marks.where("exact").select(F.lit(NO_SOURCE).alias("source"), "unit", "length", "exact").distinct())


def _line(rows: DataFrame, x: Column, y: Column) -> tuple[float, float]:
    """Slope and height of a resistant line: through the lower quartiles of y in the outer thirds of x. Two rows reach the driver."""
    flat = rows.select(x.cast("double").alias("x"), y.cast("double").alias("y"))
    thirds = flat.agg(F.percentile_approx("x", [1 / 3, 2 / 3], 1000).alias("t")).first()["t"]
    if not thirds:
        return 0.0, 0.0
    low, high = (F.when(c, True) for c in (F.col("x") <= thirds[0], F.col("x") >= thirds[1]))
    mid = lambda side, of, at: F.percentile_approx(F.when(side, F.col(of)), F.lit(at), F.lit(1000))
    r = flat.agg(mid(low, "x", 0.5).alias("x0"), mid(low, "y", 0.25).alias("y0"), mid(high, "x", 0.5).alias("x1"), mid(high, "y", 0.25).alias("y1")).first()
    slope = (r["y1"] - r["y0"]) / (r["x1"] - r["x0"]) if r["x1"] != r["x0"] else 0.0
    return slope, r["y0"] - slope * r["x0"]


def _surplus(seen: DataFrame) -> Column:
    """How much more the headers promise than a whole text of this size needs, in bytes; packed pages are scaled up and by the root of the size.

    The size of a page around a text – its frame, what a line costs – and the packed size are read off the texts that end with a terminator.
    """
    ended = seen.where((F.col("state") == "ended") & F.col("promised").isNotNull())
    text = F.col("n_bytes") + F.col("escaped")
    per_line, frame = _line(ended.where(~F.col("zipped")), F.col("n_lines"), F.col("promised") - text)
    size = text + per_line * F.col("n_lines") + frame
    packed, height = _line(ended.where("zipped"), size, F.col("promised"))
    unpacked = ((F.col("promised") - height) / packed - size) / F.sqrt(F.greatest(size, F.lit(1.0))) if packed > 0 else F.lit(None)
    return F.when(F.col("zipped"), unpacked).otherwise(F.col("promised") - size).cast("double")


def _promise(torn: dict[str, float], level: str) -> float:
    """How many times as often torn texts have this level of surplus as whole ones; a level reads ``kind passed of``, in quantiles.

    Of whole texts the part beyond a quantile is what the quantile says; torn texts are counted.
    """
    if level == "none":
        return 1.0
    kind, passed, of = level.split(" ")
    expected = (LEVELS[int(passed)] if passed != of else 1.0) - (LEVELS[int(passed) - 1] if passed != "0" else 0.0)
    known = sum(n for other, n in torn.items() if other.split(" ")[0] == kind)
    return (torn[level] + expected) / (known + 1.0) / expected


def mixture(cells: list[tuple[str, str, int]]) -> tuple[float, dict[str, float], dict[str, float]]:
    """Solve the mixture of whole and cut texts on ``(state, level, number)``, at most one cell per end state and level of surplus.

    Returns the share of cut texts and, per state and per level, how many times as often cut texts have it as whole ones. What headers promise cut
    texts is known from those torn within a character, tag, quote or bracket; how often either kind ends in each state follows by
    expectation maximisation, beginning with the torn ones. Headers that promise no more do not clear a text in one of the states ``BARE``. A state nothing is open in has factor 0.
    """
    states, levels = sorted({c[0] for c in cells} | set(OPEN) | set(CLOSED)), sorted({c[1] for c in cells} | {"none"})
    n = {(s, h): 0.0 for s in states for h in levels}
    for s, h, number in cells:
        n[s, h] += number
    torn = {h: sum(n[s, h] for s in TORN) for h in levels}
    promise = {h: _promise(torn, h) for h in levels}
    level = {(s, h): max(promise[h], 1.0) if s in BARE else promise[h] for s, h in n}
    normal = lambda d: {k: v / sum(d.values()) for k, v in d.items()}
    z = {(s, h): SEED if s in TORN else 0.05 if s in OPEN else 0.0 for s, h in n}
    share, e0, e1 = 0.0, {}, {}
    for _ in range(200):
        lost = {s: sum(n[s, h] * z[s, h] for h in levels) for s in states}
        e1 = normal({s: lost[s] + 1e-3 if s in OPEN else 0.0 for s in states})
        e0 = normal({s: sum(n[s, h] for h in levels) - lost[s] + 1e-3 for s in states})
        share = (sum(lost.values()) + 1e-3) / (sum(n.values()) + 1)
        for s, h in n:
            odds = share / (1 - share) * e1[s] / e0[s] * level[s, h]
            z[s, h] = max(odds / (1 + odds), SEED if s in TORN and h == "none" else 0.0)
    return share, {s: e1[s] / e0[s] for s in states}, promise


def _salted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with a table of one row per source, a frequent source spread over ``SALTS`` groups."""
    spread = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return left.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(spread, [key, "salt"], "left").drop("salt")


def truncated(docs: DataFrame) -> DataFrame:
    """``doc_id, source, truncated, cause, backing`` of every document with text.

    ``docs``: ``doc_id, text, source, headers, raw_bytes``; all but the first two may be NULL. ``cause`` is what the automaton found open at the end (``OPEN``, or
    ``ellipsis`` put in place of the rest at exactly a limit); ``backing`` is what made it count, the first of ``page``, ``limit`` and ``baseline`` (how often
    whole and cut texts of the source end so, with what its headers promise) that does.

    A text known to end where its whole page ends is not truncated, whatever its end looks like, nor is one that a terminator closes. NULL and empty texts are
    left out, and texts of white space are whole; documents without a source form a source of their own and are held against the exact limits of any;
    repeated documents are judged each by itself; an empty table gives an empty result; other columns are not read.
    """
    seen = cut(features(docs))
    marks = limits(seen)
    group = F.coalesce("source", F.lit(NO_SOURCE))
    held = seen.select("doc_id", "source", group.alias("group"), "state", "page", "zipped", "n_chars", "n_bytes", _surplus(seen).alias("surplus"))
    for unit in ("chars", "bytes"):
        at = marks.where(F.col("unit") == unit).select(F.col("source").alias("group"), F.col("length").alias(f"n_{unit}"), F.col("exact").alias(f"at_{unit}"))
        held = held.join(at, ["group", f"n_{unit}"], "left")
    # Levels of surplus, measured from the middle of the source's ended texts in units of their spread.
    kind = F.when(F.col("surplus").isNull(), "none").when(F.col("zipped"), "packed").otherwise("plain")
    ended = (F.col("state") == "ended") & F.col("surplus").isNotNull()
    spread = held.where(ended).groupBy("group", kind.alias("kind")).agg(F.percentile_approx("surplus", [0.5, 0.9], 1000).alias("m"))
    by_kind = spread.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("kind", "m"))).alias("kinds"))
    m = F.col("kinds")[kind]
    joined = cut(_salted(held, by_kind, "group").withColumn("far", (F.col("surplus") - m[0]) / F.greatest(m[1] - m[0], F.lit(1.0))))
    kinds = {r["kind"]: r for r in joined.where(ended).groupBy(kind.alias("kind")).agg(F.percentile_approx("far", LEVELS, 20000).alias("levels"), F.count(F.lit(1)).alias("n")).collect()}
    exact = F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False))
    open_ = F.col("state").isin(*OPEN)
    limit = (open_ & (F.col("at_chars").isNotNull() | F.col("at_bytes").isNotNull())) | ((F.col("state") == "ellipsis") & exact)
    level = F.lit("none")
    for k, r in kinds.items():
        told = sum((1 - q) * (r["n"] + 1) >= 1 for q in LEVELS)
        passed = sum(((F.col("far") > edge).cast("int") for edge in r["levels"][:told]), F.lit(0))
        if told:
            level = F.when((kind == k) & F.col("far").isNotNull(), F.concat_ws(" ", F.lit(k), passed.cast("string"), F.lit(str(told)))).otherwise(level)
    judged = cut(joined.select("doc_id", "source", "group", "state", "page", limit.alias("limit"), level.alias("level")))

    cells = judged.where(~F.col("limit")).groupBy("group", "state", "level").agg(F.count(F.lit(1)).alias("n"))
    cells = cut(cells)
    share, by_state, by_level = mixture([tuple(r) for r in cells.groupBy("state", "level").agg(F.sum("n")).collect()])
    factor = lambda of, name: F.coalesce(F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[F.col(name)], F.lit(1.0))
    promise = factor(by_level, "level")
    ratio = factor(by_state, "state") * F.when(F.col("state").isin(*BARE), F.greatest(promise, F.lit(1.0))).otherwise(promise)
    # The share of cut texts a source comes to, starting from one of them at the share of all sources.
    own_share = cells.groupBy("group").agg(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), ratio.alias("r"))).alias("c"))  # a few hundred cells at most
    step = lambda t, _: (F.aggregate("c", F.lit(0.0), lambda s, c: s + c["n"] * t * c["r"] / (1 - t + t * c["r"])) + 1) / (F.aggregate("c", F.lit(0.0), lambda s, c: s + c["n"]) + 1 / share)
    priors = own_share.select("group", F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(share), step).alias("prior"))

    odds = F.col("prior") / (1 - F.col("prior")) * ratio
    backing = (
        F.when(F.col("page") == "whole", None)
        .when(F.col("page").isin("goes_on", "broken") & (open_ | F.col("limit")), F.lit("page"))
        .when(F.col("limit"), F.lit("limit"))
        .when(open_ & (odds > SURE / (1 - SURE)), F.lit("baseline"))
    )
    return _salted(judged, priors, "group").select("doc_id", "source", backing.isNotNull().alias("truncated"), F.when(backing.isNotNull(), F.col("state")).alias("cause"), backing.alias("backing"))


def rates(judged: DataFrame) -> DataFrame:
    """Per source: documents with text, truncated ones, those at a limit and those that stop within a character, tag, quote or bracket, and the rate."""
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        count(F.col("truncated")).alias("n_truncated"),
        count(F.col("backing") == "limit").alias("n_limit"),
        count(F.col("cause").isin(*TORN)).alias("n_torn"),
        F.avg(F.col("truncated").cast("double")).alias("rate"),
    )
