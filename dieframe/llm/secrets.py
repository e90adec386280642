"""Secret scans: fixed patterns, and a character-level convolutional network over every other candidate.

1. A candidate is any run of 6 or more token characters; the network sees it whole, with 16 characters before it
   and 4 after it. One of over 80 characters is seen through windows of 80, each by half over the next one, and the
   highest score counts.
2. Windows that hold the value of a base span (or of a labelled finding) are the positives, runs that touch none
   the negatives. The network is fitted on at most `most` of each kind of finding and `most / 8` of each make-up of the
   others (digits, letters, signs, length), chosen by a hash, so that numbers, addresses and names are among the
   negatives however rare they are; runs made up as findings are, of digits and letters, are not fitted on, since some
   may be secrets that no pattern knows. All windows of all texts are scored, those too; histograms of those scores
   calibrate the network and give the threshold: a probability of one half, or lower where the recall of some kind of
   finding would otherwise fall below `recall`.
3. The other candidates, and what a base span leaves of its run, are scored where they stand; those that reach the
   threshold become spans of kind cnn.

Scoring lays the texts of a slice end to end. What a filter gives for a window depends on its characters and on
whether they stand in the value or beside it, so it is looked up by pairs of characters, once for each of the two.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, by_value, cut, mix, released, sized, table
from .convnet import LOW, ConvNet

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "cnn")
#: Labels of windows: 1 to 3 hold a base value of that kind, 4 a labelled finding. A rest is scored, but no negative.
OTHER, OWN, REST = 0, 4, -1
STRATA = 32  # kinds of finding, and from the middle on make-ups of the others
LEFT, VALUE, RIGHT, LEAST = 16, 80, 4, 6
#: A symbol is a printable ASCII character, any other character (95) or none (96).
ANY, NONE = 95, 96
SYMBOL = np.array([c - 32 if 32 <= c < 127 else ANY for c in range(128)], np.uint8)
TOKEN = np.array([c < ANY and (chr(c + 32).isalnum() or chr(c + 32) in "+/_.=-") for c in range(NONE + 1)])
#: Of a symbol: digit, lower, upper, token sign, anything else.
CLASS = np.array([0 if 16 <= c < 26 else 1 if 65 <= c < 91 else 2 if 33 <= c < 59 else 3 if TOKEN[c] else 4 for c in range(NONE + 1)])
#: Of a symbol: itself, letters without case; the class tells the case.
FOLDED = np.array([c + 32 if 33 <= c < 59 else c for c in range(NONE + 1)])
FEATURES = 2 * NONE + 10
BASE = U(0x9E3779B97F4A7C15)
UNBASE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
REGION = 8192  # characters whose activations are held at once
STEPS, FAR = 64, 64
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SPAN_DDL = "array<struct<kind: string, start: long, end: long>>"


def base_values(text: str) -> list[tuple[str, int, int, int, int]]:
    """Kind, start, end, and start and end of the value, by start, then kind as listed.

    Short runs of the last two kinds hold no long one, so lengths stand in the patterns.
    """
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [x[:3] for x in base_values(text)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, BASE)), np.cumprod(np.full(n, UNBASE))


class Laid:
    """Texts end to end, each behind 16 places without a character; as many stand at the end."""

    def __init__(self, texts: list[str]):
        gap = "\0" * LEFT
        self.text = gap + gap.join([*texts, ""])
        self.code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.array([len(x) for x in texts], np.int64)
        self.start = np.cumsum(size + LEFT) - size
        self.symbol = SYMBOL[np.minimum(self.code, 127)]
        ends = np.append(self.start, len(self.code))
        self.symbol[(ends[:, None] - np.arange(1, LEFT + 1)).ravel()] = NONE

    def around(self, a: int, b: int) -> str:
        """A value behind up to 16 characters before it and in front of up to 4 after it; zeros mark it."""
        own = self.start[np.searchsorted(self.start, a, "right") - 1]
        end = np.append(self.start, len(self.code))[np.searchsorted(self.start, a, "right")] - LEFT
        before, after = self.text[max(own, a - LEFT) : a], self.text[b : min(end, b + RIGHT)]
        return "\0".join([before.replace("\0", "\1"), self.text[a:b], after.replace("\0", "\1")])

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """64 bits of what the network sees of each window: equal ones where that is equal."""
        with np.errstate(over="ignore"):
            up, down = _powers(len(self.code) + 1)
            summed = np.append(U(0), np.cumsum((self.code + U(1)) * up[:-1]))
            ends = np.append(self.start, len(self.code))
            own = np.searchsorted(self.start, a, "right")
            low, high = np.maximum(self.start[own - 1], a - LEFT), np.minimum(ends[own] - LEFT, b + RIGHT)
            seen = (summed[high] - summed[low]) * down[low]
            return mix(mix(seen) + ((a - low) << 32).astype(U) + (b - low).astype(U))


def _touched(run: tuple[int, int], base: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """Of a run that touches spans: windows that touch a value, with its kind, and the parts outside all spans."""
    a, b = run
    for x, y in zip(*split(np.array([a]), np.array([b]))[:2]):
        kinds = [(KINDS.index(k) + 1 if k in KINDS else OWN) for k, _, _, s, e in base if s < y and e > x]
        if kinds:
            yield int(x), int(y), kinds[0]
    at = a
    for _, s, e, _, _ in [*sorted(base, key=lambda x: x[1:3]), (None, b, b, b, b)]:
        if min(s, b) - at >= LEAST:
            yield at, min(s, b), REST
        at = max(at, e)


def candidates(laid: Laid, base: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and label of every run that touches no span, every window with a value, and every rest, by start."""
    edge = np.flatnonzero(np.diff(TOKEN[laid.symbol].view(np.int8), prepend=0, append=0))
    a, b = edge[::2], edge[1::2]
    long = b - a >= LEAST
    a, b = a[long], b[long]
    touched: dict[int, list[tuple]] = {}
    for at, spans in zip(laid.start.tolist(), base):
        for k, *of in spans:
            mine = (k, *(x + at for x in of))
            for i in range(np.searchsorted(b, mine[1], "right"), np.searchsorted(a, mine[2], "left")):
                touched.setdefault(i, []).append(mine)
    near = np.zeros(len(a), bool)
    near[[*touched]] = True
    rows = [x for i, spans in touched.items() for x in _touched((int(a[i]), int(b[i])), spans)]
    more = np.array(rows, np.int64).reshape(-1, 3)
    a, b, label = np.append(a[~near], more[:, 0]), np.append(b[~near], more[:, 1]), np.append(np.zeros((~near).sum(), np.int64), more[:, 2])
    order = np.argsort(a, kind="stable")
    return a[order], b[order], label[order]


def split(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of each candidate: start, end, and the candidate's place."""
    many = np.where(b - a > VALUE, -(-(b - a - VALUE) // (VALUE // 2)) + 1, 1)
    owner = np.repeat(np.arange(len(a)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    low = np.minimum(a[owner] + nth * (VALUE // 2), np.maximum(a[owner], b[owner] - VALUE))
    return low, np.minimum(b[owner], low + VALUE), owner


def features(around: str) -> np.ndarray:
    """(positions, 2): rows of each character and of its class, both by the side it stands on; marks have row 0."""
    code = np.frombuffer(around.encode("utf-32-le", "surrogatepass"), "<u4")
    symbol, mark = SYMBOL[np.minimum(code, 127)].astype(np.int64), code == 0
    beside = np.cumsum(mark) != 1
    rows = np.stack([1 + FOLDED[symbol] + NONE * beside, 1 + 2 * NONE + CLASS[symbol] + 5 * beside], 1)
    rows[mark] = 0
    return rows


class Detector:
    """A fitted network of filters 2 and 4 wide as tables by pairs of characters, and a threshold for its logit.

    recall (by kind) and precision are those of the windows that it was calibrated on.
    """

    def __init__(self, net: ConvNet, least: float = 0.0):
        self.out, self.base, self.least = net.out, net.base, least
        self.recall, self.precision = {}, None
        self.scale, self.shift, self.filters = net.scale, net.shift, net.filters
        self.first, self.second = zip(*(self._tables(net, side) for side in (0, 1)))

    def _tables(self, net: ConvNet, side: int) -> tuple[np.ndarray, np.ndarray]:
        s = np.arange(NONE)
        e = net.emb[1 + FOLDED[s] + NONE * side] + net.emb[1 + 2 * NONE + CLASS[s] + 5 * side]
        pair = lambda w, k: (e @ net.taps[w][k])[:, None] + (e @ net.taps[w][k + 1])[None, :]
        tables = []
        for made in (np.concatenate([pair(0, 0) + net.bias[0], pair(1, 0) + net.bias[1]], axis=2), pair(1, 2)):
            full = np.full((NONE + 1, NONE + 1, made.shape[2]), LOW, np.float32)
            full[:NONE, :NONE] = made
            tables.append(full.reshape(-1, made.shape[2]))
        return tables[0], tables[1]

    def logits(self, symbol: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of windows by start, in laid-out symbols."""
        out = np.empty(len(a), np.float32)
        edge = np.append(np.flatnonzero(np.diff(a // REGION, prepend=-1)), len(a)) if len(a) else []
        for i, j in zip(edge[:-1], edge[1:]):
            low = a[i] - LEFT
            s = symbol[low : b[i:j].max() + RIGHT].astype(np.int64)
            pair = s[:-1] * (NONE + 1) + s[1:]
            out[i:j] = self._region(pair, a[i:j] - low, b[i:j] - low)
        return out

    def _activations(self, pair: np.ndarray, side: int) -> np.ndarray:
        """(positions, 2 * filters) of the windows of 2 and of 4 that begin at each position."""
        h = self.first[side].take(pair, axis=0)
        h[:-2, self.filters :] += self.second[side].take(pair[2:], axis=0)
        return h

    def _region(self, pair: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        f = self.filters
        inside, beside = self._activations(pair, 0), self._activations(pair, 1)
        pool = np.maximum.reduceat(inside, np.stack([a, b - 3], 1).ravel(), axis=0)[::2]
        two = [inside[b - 3, :f], inside[b - 2, :f], beside[b, :f], beside[b + 1, :f], beside[b + 2, :f]]
        wide = beside
        for k in (1, 2, 4):  # the highest of 8 positions
            wide = np.maximum(wide[:-k], wide[k:])
        first = wide.take(a - LEFT, axis=0)
        two += [first[:, :f], wide[a - LEFT + 7, :f]]
        four = [first[:, f:], wide[a - LEFT + 5, f:], beside[b, f:]]
        for x in two:
            np.maximum(pool[:, :f], x, out=pool[:, :f])
        for x in four:
            np.maximum(pool[:, f:], x, out=pool[:, f:])
        return np.maximum(pool, 0) @ self.out + self.base

    def highest(self, laid: Laid, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The highest logit of each candidate's windows."""
        low, high, owner = split(a, b)
        z = self.logits(laid.symbol, low, high)
        return np.maximum.reduceat(z, np.flatnonzero(np.diff(owner, prepend=-1))) if len(a) else z

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -40, 40)))


@dataclass
class Slice:
    """Some texts laid out, with their base spans, their labelled findings and the windows that carry a label."""

    part: pa.RecordBatch

    def __post_init__(self) -> None:
        texts = [x or "" for x in self.part.column("text").to_pylist()]
        own = self.part.column("own").to_pylist() if "own" in self.part.schema.names else [None] * len(texts)
        base = [base_values(x) + [("own", s["start"], s["end"], s["start"], s["end"]) for s in o or ()] for x, o in zip(texts, own)]
        self.laid = Laid(texts)
        a, b, label = candidates(self.laid, base)
        self.a, self.b, owner = split(a, b)
        self.label = label[owner]
        labelled = self.label != REST
        self.a, self.b, self.label = self.a[labelled], self.b[labelled], self.label[labelled]
        self.hash = self.laid.hashes(self.a, self.b).view(np.int64)
        self.stratum = np.where(self.label > 0, self.label, STRATA // 2 + make_up(self.laid.symbol, self.a, self.b))


def make_up(symbol: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of windows: 1 with digits, 2 with letters, 4 with signs, 8 with 20 characters or more, added up."""
    out = 8 * (b - a >= 20)
    for bit, kind in ((1, (0,)), (2, (1, 2)), (4, (3, 4))):
        many = np.append(0, np.cumsum(np.isin(CLASS, kind)[symbol]))
        out = out + bit * (many[b] > many[a])
    return out


def _free(h: np.ndarray) -> np.ndarray:
    """Four fifths of the windows, from which those to fit on are taken."""
    return h % 5 > 0


def _quota(stratum: int, most: int) -> int:
    return most if stratum < STRATA // 2 else max(1, most // 8)


def _lowest(most: int):
    """Of each task's windows, the distinct ones of each stratum that come first by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[int, str]] = [{} for _ in range(STRATA)]
        for part in sized(batches, 0):
            s = Slice(part)
            for stratum in range(STRATA):
                mine = np.flatnonzero((s.stratum == stratum) & _free(s.hash))
                quota = _quota(stratum, most)
                order, first = np.unique(s.hash[mine], return_index=True)
                last = max(kept[stratum]) if len(kept[stratum]) >= quota else np.iinfo(np.int64).max
                for h, i in zip(order[:quota].tolist(), mine[first[:quota]].tolist()):
                    if h > last:
                        break
                    kept[stratum][h] = s.laid.around(s.a[i], s.b[i])
                kept[stratum] = dict(sorted(kept[stratum].items())[:quota])
        rows = [(stratum, h, x) for stratum, of in enumerate(kept) for h, x in of.items()]
        kinds = {"stratum": pa.int32(), "h": pa.int64(), "around": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=[*kinds])

    return run


def _undecided(t: pa.Table) -> list[int]:
    """Make-ups of digits and letters that a tenth of the findings have: a run of that make-up that no pattern knows may be a secret, so it is no negative to fit on."""
    values = [x.split("\0")[1] for x, stratum in zip(t["around"].to_pylist(), t["stratum"].to_pylist()) if stratum < STRATA // 2]
    laid = Laid(values)
    size = np.array([*map(len, values)], np.int64)
    many = np.bincount(make_up(laid.symbol, laid.start, laid.start + size), minlength=STRATA // 2) if values else np.zeros(STRATA // 2)
    return [STRATA // 2 + m for m in range(STRATA // 2) if m & 3 == 3 and 10 * many[m] >= len(values) > 0]


def _fitted(around: list[str], label: np.ndarray, seed: int) -> dict:
    net = ConvNet(np.arange(FEATURES, dtype=U), size=8, widths=(2, 4), filters=8, seed=seed, gaps=True)
    net.fit([features(x) for x in around], label, epochs=max(4, 20_000 // len(around)), seed=seed)
    return vars(net)


def _histogram(shared, last: np.ndarray):
    """How many windows of each label, fitted on or not, have a logit in each step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = pickle.loads(shared.value)
        many: Counter = Counter()
        for part in sized(batches, 0):
            s = Slice(part)
            z = np.clip(detector.logits(s.laid.symbol, s.a, s.b), -FAR, FAR)
            step = np.floor(z * STEPS).astype(np.int64) + FAR * STEPS
            fit = _free(s.hash) & (s.hash <= last[s.stratum])
            keys, counts = np.unique((step * 8 + s.label) * 2 + fit, return_counts=True)
            many.update(dict(zip(keys.tolist(), counts.tolist())))
        rows = [(k // 2 % 8, bool(k % 2), k // 16 - FAR * STEPS, n) for k, n in sorted(many.items())]
        kinds = {"label": pa.int32(), "fit": pa.bool_(), "step": pa.int32(), "many": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=[*kinds])

    return run


def threshold(step: np.ndarray, label: np.ndarray, many: np.ndarray, recall: float) -> float:
    """The highest logit that leaves each kind of finding at least `recall` of its windows."""
    least = []
    for kind in np.unique(label[label > 0]):
        order = np.argsort(step[label == kind])
        below = np.cumsum(many[label == kind][order])
        least.append(step[label == kind][order][np.searchsorted(below, (1 - recall) * below[-1], "right")] / STEPS)
    return min(least)


def train(docs: DataFrame, found: DataFrame | None = None, most: int = 3000, recall: float = 0.98, seed: int = 11) -> Detector | None:
    """A detector fitted on docs (text, and doc_id where `found` is given). Scans docs twice.

    found: labelled findings beyond the base patterns' (doc_id, start, end; code points, end exclusive). At most
    `most` windows of each of the four kinds of finding and `most / 8` of each of 16 make-ups of the others, by a hash of
    what they show, are fitted on, in one task. All the others, or those of a kind that has no others, calibrate the
    network and set the threshold.

    Null and empty texts have no windows. Without a finding and without a candidate that is none, there is
    nothing to learn from: None, and `scan` then gives base spans alone.
    """
    rows = docs.select("text")
    if found is not None:
        own = found.where("start < end").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("own"))
        rows = docs.select("doc_id", "text").join(own, "doc_id", "left").select("text", "own")
    sample = cut(rows.mapInArrow(released(_lowest(most)), "stratum int, h long, around string"))
    # Each task gives its lowest; of those, the lowest again.
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("h"))
    quota = F.when(F.col("stratum") < STRATA // 2, _quota(0, most)).otherwise(_quota(STRATA - 1, most))
    lowest = sample.dropDuplicates(["stratum", "h"]).withColumn("place", place).where(F.col("place") <= quota).drop("place")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("stratum", "ascending"), ("h", "ascending")])
        t = t.filter(pa.array(~np.isin(t["stratum"].to_numpy(), _undecided(t))))
        stratum = t["stratum"].to_numpy()
        label, last = (stratum < STRATA // 2).astype(np.float64), np.full(STRATA, np.iinfo(np.int64).min)
        np.maximum.at(last, stratum, t["h"].to_numpy())
        fitted = _fitted(t["around"].to_pylist(), label, seed) if len(np.unique(label)) == 2 else None
        return pa.table({"net": pa.array([pickle.dumps((fitted, last))], pa.binary())})

    made = lowest.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "net binary").collect()
    fitted, last = pickle.loads(made[0].net) if made else (None, None)
    if fitted is None:
        return None
    net = ConvNet(fitted.pop("vocabulary"))
    vars(net).update(fitted)
    shared = by_value(docs.sparkSession, Detector(net))
    bins = rows.mapInArrow(released(_histogram(shared, last)), "label int, fit boolean, step int, many long").groupBy("label", "fit", "step").agg(F.sum("many").alias("many")).collect()
    unseen = {r.label for r in bins if not r.fit}
    bins = [r for r in bins if not r.fit or r.label not in unseen]
    label, step, many = (np.array([r[c] for r in bins]) for c in ("label", "step", "many"))
    net.calibrate((step + 0.5) / STEPS, (label > 0).astype(np.float64), many.astype(np.float64))
    half = -net.shift / net.scale if net.scale else np.inf
    out = Detector(net, min(half, threshold(step, label, many, recall)))
    sure = step >= np.floor(out.least * STEPS)
    out.recall = {[*KINDS[:3], "own"][k - 1]: float(many[sure & (label == k)].sum() / many[label == k].sum()) for k in np.unique(label[label > 0]).tolist()}
    out.precision = float(many[sure & (label > 0)].sum() / max(1, many[sure].sum()))
    return out


def _spans(texts: list[str | None], d: Detector | None) -> list[list[tuple[str, int, int]]]:
    """Base spans and those that the network adds, by start, then kind."""
    base = [base_values(x or "") for x in texts]
    out = [[x[:3] for x in of] for of in base]
    if d is None:
        return out
    laid = Laid([x or "" for x in texts])
    a, b, label = candidates(laid, base)
    a, b = a[label <= OTHER], b[label <= OTHER]
    sure = np.flatnonzero(d.highest(laid, a, b) >= d.least)
    for s, e in zip(a[sure].tolist(), b[sure].tolist()):
        i = int(np.searchsorted(laid.start, s, "right")) - 1
        out[i].append(("cnn", s - int(laid.start[i]), e - int(laid.start[i])))
    return [sorted(x, key=lambda y: (y[1], KINDS.index(y[0]))) for x in out]


def scan(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive; by start, then kind) of each row.

    Null and empty texts have none. Base spans always stay, whatever the network says; it only adds spans
    of kind cnn. Rows that share an id keep a row each. Texts of any length are laid out whole. Ids of any type stay
    as they are; other columns are left out, whatever their names.
    """
    shared = by_value(docs.sparkSession, detector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for part in sized(batches, 1):
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in x] for x in _spans(part.column(1).to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "spans"])

    own_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {own_type}, spans {SPAN_DDL}")


def masked(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with the union of the spans replaced by a mark each."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, detector: Detector | None) -> DataFrame:
    """docs with every found span replaced by [SECRET] in its text and n_chars set anew; rows without spans stay as they are."""
    names = docs.columns
    shared = by_value(docs.sparkSession, detector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for part in sized(batches, names.index("text")):
            texts = part.column(names.index("text")).to_pylist()
            spans = [[(a, b) for _, a, b in x] for x in _spans(texts, own)]
            texts = [masked(x, s) if s else x for x, s in zip(texts, spans)]
            sizes = [len(x) if s else n for x, s, n in zip(texts, spans, part.column(names.index("n_chars")).to_pylist())]
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, part.column(i)) for i, c in enumerate(names)], names=names)

    return docs.mapInArrow(released(run), docs.schema)


def _joined(spans: str):
    return F.array_join(F.expr(f"transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end))"), ",")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of each document; the network is trained on all of them."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    many = lambda kind: F.size(F.expr(f"filter(spans, s -> s.kind = '{kind}')")).cast("long").alias(f"n_{kind}")
    base = F.sha2(_joined("filter(spans, s -> s.kind <> 'cnn')"), 256).alias("base_sha256")
    return found.select("doc_id", many("assign"), many("access"), many("hex"), base, _joined("spans").alias("spans"))
