"""Personal data in texts: generators propose overlapping spans, boosted trees judge them.

Base spans follow fixed rules (BASE below) and are always kept. High-recall
generators also propose looser spans of the same kinds: spelled-out mail addresses,
digit groups without a leading plus, spaced or bracketed dots, parts of base spans.
Trees boosted on format and context features score them, an isotonic fit turns
scores into probabilities, and a threshold per kind is set on rows held out from
the trees. All texts teach: their proposals are counted by what trees can tell apart,
and every level of a tree is one Spark job over those counts. Labels come from the base rules too, applied to what a proposal says once
its disguise is undone (`plain`): a spelled-out sign or dot, brackets and blanks, a
missing plus. Features see the undone form, so base spans teach what their disguised
kin look like. Undone forms that ordinary prose has as well (a bare "at" before a
dotted word, dates, one run of digits) are marked and count as not personal.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from . import common

#: Kinds in their order (fixed values), as are the rules: least and most digits of cards and phones, greatest part of an address.
KINDS = ("email", "ip", "card", "phone")
CARD_DIGITS, PHONE_DIGITS, IP_PART = (12, 19), (9, 15), 255

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(r"(?:\(at\)|\[at\]|\{at\}|(?<=\s)at(?=\s)|＠)", re.IGNORECASE)
_SPELLED_DOMAIN = re.compile(r"\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s|\.)\s?[A-Za-z0-9-]{2,63}){1,8}", re.IGNORECASE)
_SPELLED_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?\Z")
_LOOSE = re.compile(r"[+(]{0,2}(?<![0-9])[0-9](?:[ ().-]{0,3}[0-9]){6,24}(?![0-9])")
_SPELLED_DOT = re.compile(r"\s?(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?", re.IGNORECASE)
_BRACKETED_DOT = re.compile(r"\s?(?:\.|\[\.\]|\(\.\))\s?")
_DATE = re.compile(r"(?:19|20)[0-9]{2}([-. ])[0-9]{1,2}\1[0-9]{1,2}(?![0-9])|[0-9]{1,2}([-. ])[0-9]{1,2}\2(?:19|20)[0-9]{2}(?![0-9])")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++\Z")
_DOTS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\))\s?[0-9]{1,3}){3}(?![0-9.])")
_HINTS = tuple(re.compile(p, re.IGNORECASE) for p in (r"mail|contact|write|@", r"\bip\b|host|server|addr", r"card|visa|pay|credit", r"phone|tel\b|call|fax|mobile", r"token|key|secret|password|hash|id\b|=|\""))


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, by start, then kind; each kind leftmost and non-overlapping."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:  # the local part ends at the sign, so it is read backwards from there
        start = at
        while start > floor and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= IP_PART for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            d = _digits(m.group())
            if CARD_DIGITS[0] <= len(d) <= CARD_DIGITS[1] and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if PHONE_DIGITS[0] <= len(_digits(m.group())) <= PHONE_DIGITS[1]:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) proposed beside the base rules; they may overlap base spans and each other."""
    out = []
    for m in _SPELLED.finditer(text):
        before, after = _SPELLED_LOCAL.search(text, max(0, m.start() - 66), m.start()), _SPELLED_DOMAIN.match(text, m.end())
        if before and after:
            out.append((before.start(), 0, after.end()))
    out += [(m.start(), 1, m.end()) for m in _DOTS.finditer(text)]
    for m in _LOOSE.finditer(text):
        n = len(_digits(m.group()))
        if CARD_DIGITS[0] <= n <= CARD_DIGITS[1]:
            out.append((m.start(), 2, m.end()))
        if 7 <= n <= PHONE_DIGITS[1]:
            out.append((m.start(), 3, m.end()))
    for start, kind, end in base:
        if kind == 3 and (m := _LOOSE.search(text, start + 2, end)) and "(" in text[start:end]:
            out.append((text.index("(", start), 3, end))  # the same number without its country
        elif kind == 0:
            out.append((start, 0, end))
    return sorted(set(out))


def plain(kind: int, span: str) -> tuple[str, bool]:
    """What a span says without its disguise, and whether ordinary prose looks like that too.

    Mail addresses get their sign and dots back, ip addresses their dots; digits stay as
    they are written, phones without their plus. Prose: a bare "at" with no dot spelled
    out, blanks on one side of a dot, dates, addresses and runs of one or two groups of
    digits that have neither plus nor brackets.
    """
    if kind == 0:
        dotted, dots = _SPELLED_DOT.subn(".", span)
        sign = _SPELLED.search(dotted)
        if sign is None:
            return "".join(dotted.split()), False
        return "".join((dotted[: sign.start()] + "@" + dotted[sign.end() :]).split()), sign.group().lower() == "at" and not dots
    if kind == 1:
        uneven = any(m.group()[0].isspace() != m.group()[-1].isspace() for m in _BRACKETED_DOT.finditer(span))
        return _BRACKETED_DOT.sub(".", span), uneven
    written = span.lstrip("+")
    if kind == 2 or written != span:
        return written, False
    groups = len(re.findall(r"[0-9]+", span))
    return written, bool(_DATE.match(span)) or bool(_DOTS.fullmatch(span)) or (groups < 3 and "(" not in span)


def personal(kind: int, span: str) -> bool:
    """Whether a span follows its kind's base rule once its disguise is undone."""
    said, prose = plain(kind, span)
    if prose:
        return False
    if kind == 0:
        return bool(_MAIL.match(said))
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= IP_PART for p in said.split("."))
    d = _digits(said)
    if kind == 2:
        return CARD_DIGITS[0] <= len(d) <= CARD_DIGITS[1] and luhn(d)
    return PHONE_DIGITS[0] <= len(d) <= PHONE_DIGITS[1]


def labels(text: str, found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[float]:
    """1 for proposals that are most of a base span of their kind, or overlap none and are personal; else 0."""
    out = []
    for start, kind, end in found:
        over = [(s, k, e) for s, k, e in base if s < end and start < e]
        inside = any(k == kind and s <= start and end <= e and 2 * (end - start) > e - s for s, k, e in over)
        out.append(float(inside or (not over and personal(kind, text[start:end]))))
    return out


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of a span as it reads without its disguise."""
    span, prose = plain(kind, text[start:end])
    d, before, after = _digits(span), text[max(0, start - 24) : start], text[end : end + 12]
    runs = re.findall(r"[0-9]+", span)
    left, right = before[-1:], after[:1]
    touch = lambda c: 2.0 if c.isalpha() or c == "_" else 3.0 if c.isdigit() else 1.0 if c and not c.isspace() else 0.0
    is_card = CARD_DIGITS[0] <= len(d) <= CARD_DIGITS[1] and luhn(d)
    parts_fit = bool(runs) and all(len(g) < 12 and int(g) <= IP_PART for g in runs)
    return [
        float(kind), float(len(d)), float(len(span)), float(len(runs)), float(len(runs[0]) if runs else 0), float(len(runs[-1]) if runs else 0),
        float(span.count(" ")), float(span.count("-")), float(span.count(".")), float("(" in span), float(sum(c.isalpha() for c in span)),
        touch(left), touch(right), float(is_card), float(parts_fit), float(len(set(d))), float(prose),
        *(float(bool(h.search(before))) for h in _HINTS),
    ]


@dataclass(frozen=True)
class Model:
    """Boosted trees (each level asks one question of all rows), the isotonic steps and the thresholds by kind."""

    prior: float
    trees: tuple[tuple[tuple[int, ...], tuple[float, ...], tuple[float, ...]], ...]
    steps: tuple[np.ndarray, np.ndarray]
    thresholds: tuple[float, ...]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for columns, cuts, leaves in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for c, t in zip(columns, cuts, strict=True):
                leaf = leaf * 2 + (x[:, c] > t)
            out += np.asarray(leaves)[leaf]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.steps_of(self.raw(x))

    def steps_of(self, raw: np.ndarray) -> np.ndarray:
        edges, values = self.steps
        return values[np.clip(np.searchsorted(edges, raw, side="right") - 1, 0, len(values) - 1)]


NOTHING = Model(-9.0, (), (np.zeros(1), np.zeros(1)), (2.0,) * len(KINDS))


#: Questions a feature has at most (so many quantiles of the rows), and the whole numbers gradients are summed in: sums don't depend on their order.
CUTS, UNIT = 15, 1 << 24
_CELLS = "kind int, bins binary, held boolean, n long, positive long"


def _binned(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bins (rows x features), how many proposals each row stands for, and how many of them are personal."""
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)
    return bins, batch.column("n").to_numpy().astype(np.float64), batch.column("positive").to_numpy().astype(np.float64)


def _cells(found: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Proposals counted by kind and the cuts between which their features lie: what trees can tell apart."""

    def place(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, len(cuts))
            bins = np.stack([np.searchsorted(t, x[:, c]) for c, t in enumerate(cuts)], 1).astype(np.uint8)
            kinds, keys = pa.array(x[:, 0].astype(np.int32)), pa.array([row.tobytes() for row in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([kinds, keys, batch.column("held"), batch.column("n"), batch.column("positive")], ["kind", "bins", "held", "n", "positive"])

    return found.mapInArrow(place, _CELLS).groupBy("kind", "bins", "held").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))


def _slopes(cells: DataFrame, model: Model, grid: np.ndarray, asked: list[tuple[int, float]]) -> np.ndarray:
    """Sums of (gradient, weight) by feature, leaf after the questions `asked`, and bin: a Spark job over all rows."""
    width, size = len(grid), (CUTS + 1) << len(asked)

    def count(batches):
        total = np.zeros((width, size, 2), np.int64)
        for batch in batches:
            bins, n, positive = _binned(batch, width)
            x, leaf = grid[np.arange(width), bins], np.zeros(len(bins), np.int64)
            p = 1 / (1 + np.exp(-model.raw(x)))
            for c, t in asked:
                leaf = leaf * 2 + (x[:, c] > t)
            for i, part in enumerate((positive - n * p, n * p * (1 - p))):
                whole = np.rint(part * UNIT)
                for c in range(width):
                    total[c, :, i] += np.bincount(leaf * (CUTS + 1) + bins[:, c], whole, size).astype(np.int64)
        flat = total.reshape(-1, 2)
        at = np.flatnonzero(flat.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at, 0]), pa.array(flat[at, 1])], ["at", "g", "h"])

    sums, out = cells.mapInArrow(count, "at long, g long, h long").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).coalesce(8).toArrow(), np.zeros((width * size, 2))
    out[sums["at"].to_numpy()] = np.stack([sums["g"].to_numpy(), sums["h"].to_numpy()], 1) / UNIT
    return out.reshape(width, 1 << len(asked), CUTS + 1, 2)


def boosted(cells: DataFrame, cuts: list[np.ndarray], prior: float, rounds: int = 40, depth: int = 3, rate: float = 0.3, smooth: float = 5.0) -> Model:
    """Gradient boosting of the log loss with trees that ask one question a level, over all cells; no steps or thresholds yet.

    The driver holds a level's sums by feature, leaf and bin, whatever the number of rows.
    """
    model = Model(prior, (), (np.zeros(1), np.zeros(1)), (2.0,) * len(KINDS))
    grid = _grid(cuts)
    for _ in range(rounds):
        asked: list[tuple[int, float]] = []
        for _ in range(depth):
            slopes = _slopes(cells, model, grid, asked)
            best, sides = (-1.0, 0, 0.0), None
            for c, questions in enumerate(cuts):
                for j, t in enumerate(questions):
                    both = np.stack([slopes[c, :, : j + 1].sum(1), slopes[c, :, j + 1 :].sum(1)], 1).reshape(-1, 2)  # no, yes of each leaf
                    gain = (float((both[:, 0] ** 2 / (both[:, 1] + smooth)).sum()), c, float(t))
                    if gain > best:
                        best, sides = gain, both
            if sides is None:
                return model  # every feature has one value
            asked.append(best[1:])
        leaves = rate * sides[:, 0] / (sides[:, 1] + smooth)
        model = Model(prior, (*model.trees, (tuple(c for c, _ in asked), tuple(t for _, t in asked), tuple(leaves.tolist()))), model.steps, model.thresholds)
    return model


def _grid(cuts: list[np.ndarray]) -> np.ndarray:
    """For each feature and bin a value that answers every question as the bin's rows do."""
    return np.array([[*t, *[np.inf] * (CUTS + 1 - len(t))] for t in cuts])


def pooled(blocks: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """Pooled adjacent violators of (least score, positives, rows) by rising score: shares rise from block to block."""
    out: list[tuple[float, float, float]] = []
    for block in blocks:
        out.append(block)
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            top = out.pop()
            out[-1] = (out[-1][0], out[-1][1] + top[1], out[-1][2] + top[2])
    return out


def _pool(batches):
    """Pools a partition whose rows come by rising score."""
    left: list[tuple[float, float, float]] = []
    for batch in batches:
        left = pooled(left + list(zip(*[c.to_pylist() for c in batch.columns], strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array([b[i] for b in left], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64()))], ["score", "positive", "n"])


def calibrated(cells: DataFrame, model: Model, cuts: list[np.ndarray], precision: float) -> Model:
    """The model with its isotonic steps and thresholds from all cells given: ranges of scores are pooled by tasks, then with each other."""
    grid = _grid(cuts)

    def score(batches):
        for batch in batches:
            bins, _, _ = _binned(batch, len(grid))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(model.raw(grid[np.arange(len(grid)), bins])), batch.column("positive"), batch.column("n")], ["kind", "score", "positive", "n"])

    counts = [F.sum("positive").alias("positive"), F.sum("n").alias("n")]
    scored = stage(cells.mapInArrow(score, "kind int, score double, positive long, n long").groupBy("kind", "score").agg(*counts), "scores")
    ranges = scored.groupBy("score").agg(*counts).repartitionByRange("score").sortWithinPartitions("score").select("score", "positive", "n")
    blocks = pooled(sorted(tuple(r) for r in ranges.mapInArrow(_pool, "score double, positive long, n long").collect()))
    model = Model(model.prior, model.trees, (np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])), model.thresholds)

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(model.steps_of(batch.column("score").to_numpy())), batch.column("positive"), batch.column("n")], ["kind", "p", "positive", "n"])

    limits, sums = [2.0] * len(KINDS), [(0, 0)] * len(KINDS)
    for r in scored.mapInArrow(place, "kind int, p double, positive long, n long").where("p >= 0.5").groupBy("kind", "p").agg(*counts).orderBy(F.desc("p")).collect():
        sums[r.kind] = (sums[r.kind][0] + r.positive, sums[r.kind][1] + r.n)
        if sums[r.kind][0] / sums[r.kind][1] >= precision:
            limits[r.kind] = r.p
    return Model(model.prior, model.trees, model.steps, tuple(limits))


def fit(docs: DataFrame, *, text: str = "text", precision: float = 0.98) -> Model:
    """Fits trees, calibration and thresholds on the proposals of all texts.

    A fourth of the texts (by their hash) is held out for the calibration; a kind's
    threshold is the least probability whose precision on them reaches `precision`,
    a kind without that has no added spans. If one side then lacks rows or a label, proposals
    are dealt by the hash of their features, or serve both sides. Null and empty texts propose
    nothing; a table without proposals of both labels fits NOTHING, which adds no span. Repeated
    rows weigh as often. Equal proposals are counted first, jobs read those counts; the result
    doesn't depend on partitions.
    """
    width = len(features("", 0, 0, 0))

    def propose(batches):
        for batch in batches:
            x, y, held = [], [], []
            for value in batch.column(0).to_pylist():
                base = base_spans(value)
                found = proposals(value, base)
                x += [features(value, *f) for f in found]
                y += labels(value, found, base)
                held += [hash_of(value) % 4 == 0] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64()), pa.array(held, pa.bool_())], ["x", "y", "held"])

    texts = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("_text"))
    counts = [F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("positive")]
    found = stage(texts.mapInArrow(propose, "x array<double>, y double, held boolean").groupBy("x", "held").agg(*counts), "proposals")
    by_vector = F.pmod(F.xxhash64("x"), F.lit(4)) == 0
    for deal in (F.col("held"), by_vector, F.lit(None)):
        sides = {r.held: r for r in found.groupBy(deal.alias("held")).agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).collect()}
        learned = sides.get(False) or sides.get(None)
        if learned and (True in sides or None in sides) and 0 < learned.positive < learned.n:
            break
    else:
        return NOTHING
    found, share = found.withColumn("held", deal.cast("boolean")), learned.positive / learned.n
    values = found.where("held is not true").select(F.posexplode("x").alias("c", "v"), "n").groupBy("c", "v").agg(F.sum("n").alias("n"))
    places = F.array(*[F.lit(q) for q in np.linspace(0, 1, CUTS + 2)[1:-1].tolist()])
    quantiles = {r.c: r.q for r in values.groupBy("c").agg(F.percentile("v", places, F.col("n")).alias("q")).collect()}
    cuts = [np.unique(quantiles[c]) for c in range(width)]
    cells = stage(_cells(found, cuts), "cells")
    model = boosted(cells.where("held is not true"), cuts, float(np.log((share + 1e-4) / (1 - share + 1e-4))))
    return calibrated(cells.where("held is not false"), model, cuts, precision)


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


Span = tuple[int, int, int, bool, float]
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))


def spans_of(model: Model, texts: list[str]) -> list[list[Span]]:
    """(start, kind, end, base, score) of each text's spans, by start, then kind."""
    every, x, place = [], [], []
    for i, value in enumerate(texts):
        base = base_spans(value)
        every.append([(s, k, e, True, 1.0) for s, k, e in base])
        known = {(s, e) for s, _, e in base}
        for s, k, e in proposals(value, base):
            if (s, e) not in known:
                x.append(features(value, s, k, e))
                place.append((i, s, k, e))
    p = model.probability(np.array(x)) if x else []
    for score, (i, s, k, e) in sorted(zip(p, place, strict=True), key=lambda c: (-c[0], c[1])):
        if score >= model.thresholds[k] and all(e <= a or s >= b for a, _, b, _, _ in every[i]):
            every[i].append((s, k, e, False, float(score)))
    return [sorted(spans) for spans in every]


def _as_array(every: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": KINDS[k], "start": s, "end": e, "base": b, "score": c} for s, k, e, b, c in spans] for spans in every], _SPANS)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; where spans overlap, one mark stands for all of them."""
    parts, at = [], 0
    for start, kind, end, _, _ in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def found(model: Model, text: Column) -> Column:
    """array<struct(kind, start, end, base, score)> of a text's spans, by start, then kind.

    Offsets are code points, the end exclusive. Base spans have score 1. An added span
    overlaps no other; of overlapping ones the likelier stays, ties go to the earlier.
    A null or empty text has none; repeated rows get equal spans, whole texts of any length are searched.
    """
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        return _as_array([spans for part in common.chunks(texts) for spans in spans_of(shared.value, part.to_pylist())])

    return find(text)


def replaced(model: Model, text: Column) -> Column:
    """struct(text, spans): the text with its spans redacted, and those spans (offsets of the text as it was). Null stays null."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<text:string,spans:{SPANS}>")
    def replace(texts: pa.Array) -> pa.Array:
        every, out = [], []
        for part in common.chunks(texts):
            values = part.to_pylist()
            found = spans_of(shared.value, values)
            every += found
            out += [redact(v, s) if s else v for v, s in zip(values, found, strict=True)]
        texts_out = pc.if_else(texts.is_valid(), pa.array(out, pa.string()), pa.scalar(None, pa.string()))
        return pa.StructArray.from_arrays([texts_out, _as_array(every)], ["text", "spans"])

    return replace(text)
