"""Evaluation texts leaking into training text."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.session import Scratch, fits_broadcast, ship_package

#: Words of a template window; of a passage; one word in so many may differ.
WINDOW, PASSAGE, ONE_IN = 5, 20, 8
#: A run of n words with e edits is enough if one of these (words, edits) is: longer runs hold one of them.
ENOUGH = tuple((max(PASSAGE, ONE_IN * e), e) for e in range(2 * PASSAGE // ONE_IN))
#: A shared window counts if another one is shared beside it (1 place on) or across one edit (5 or 6 places on, on either side).
#: So many that count a passage and its copy share at the least, wherever the edits are; tests/llm counts all cases.
LEAST_HITS = 4
#: (places on in the document, in the item): the next word, a changed, a dropped and an added word.
STEPS = ((1, 1), (6, 6), (5, 6), (6, 5))
#: The longest run that has to be looked for, and its most edits.
RUN, EDITS = ENOUGH[-1]
#: Items are looked at in segments that start every SEGMENT words and reach RUN words into the next, so that each run lies in one.
SEGMENT = 2 * RUN
REACH = SEGMENT + RUN
#: Hits of one run lie within EDITS neighbouring diagonals, so within one of two overlapping strips of them.
STRIP = 2 * EDITS
BAND = STRIP + 2 * EDITS + 1
#: Document words are kept in blocks of twice this length, one starting every BLOCK words: each segment's strip lies in one.
BLOCK = 128
#: A window without a literal word meets its like by blocks and not by places: all diagonals on which a window that starts in a block may
#: meet one of a segment are aligned at once, and those a run may move to.
BARE_BAND = BLOCK + REACH - WINDOW + 2 * EDITS
BARE_BEFORE = REACH - WINDOW + EDITS
#: Bits of the largest bitmap of hashes that is broadcast (64 MiB). More hashes set more of its bits; nothing is lost by that.
BITMAP_BITS = 29

#: Words that stand for a number.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split())
#: Units of length, area, volume, mass, time, temperature, money and share.
UNITS = frozenset(
    "km m cm mm nm metre metres meter meters kilometre kilometres kilometer kilometers mile miles yard yards foot feet ft inch inches acre acres hectare hectares ha sq square cubic "
    "litre litres liter liters l ml gallon gallons pint pints g kg mg t ton tons tonne tonnes gram grams kilogram kilograms lb lbs pound pounds ounce ounces oz stone stones "
    "second seconds minute minutes hour hours h day days week weeks month months year years decade decades century centuries "
    "degree degrees celsius fahrenheit kelvin hz khz mhz w kw mw v volt volts watt watts percent per cent "
    "dollar dollars euro euros cent cents penny pence crown crowns franc francs mark marks shilling shillings peso pesos yen rupee rupees".split()
)
LITERAL, NUM, UNIT, NAME = 0, 1, 2, 3

# --- words of a text with wiki markup ----------------------------------------------------------------------------------

_MARK = re.compile(r"<!--|-->|\{\{|\}\}|\[\[|\]\]|<ref\b[^<>]*?/>|<ref\b[^<>]*>|</ref\s*>|</?[a-zA-Z][^<>]*>|\[(?:https?:|mailto:)[^\s\[\]]*", re.I)
_ARG_NAME = re.compile(r"\s*[\w \-]{1,30}=(?!=)")
_JOIN = re.compile(r"'{2,}|[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")

#: A piece of text and how it is shown: 0 always, 1 as the last unnamed argument of a template, 2 as another one.
Piece = tuple[int, str]
_OPEN = {"<!--": "comment", "{{": "template", "[[": "link"}
_CLOSE = {"-->": "comment", "}}": "template", "]]": "link"}


def _args(items: list[Piece]) -> list[list[Piece]]:
    """The parts of a template or link between its own bars; a piece of layer -1 comes from within and has none."""
    out: list[list[Piece]] = [[]]
    for n, t in items:
        if n >= 0:
            out[-1].append((n, t))
            continue
        first, *rest = t.split("|")
        out[-1].append((0, first))
        out += [[(0, r)] for r in rest]
    return out


def stretches(text: str) -> list[list[Piece]]:
    """The stretches of a text: its body, and each comment, reference and template by itself. In the body, and wherever else they
    stand, comments and references leave a gap; templates leave what they may show; links leave what they show.

    Read in one pass with a stack, so nesting has no bound. Whatever is opened and not closed stays where it is.
    """
    out: list[list[Piece]] = []
    stack: list[tuple[str, list[Piece]]] = [("body", [])]
    at = 0

    kinds = defaultdict(int)

    def put(s: str) -> None:
        if s:
            stack[-1][1].append((-1, s))

    def push(kind: str) -> None:
        stack.append((kind, []))
        kinds[kind] += 1

    def pop() -> list[Piece]:
        kind, items = stack.pop()
        kinds[kind] -= 1
        return items

    def close(kind: str) -> None:
        if not kinds[kind]:
            return put(" ")
        while stack[-1][0] != kind:
            items = pop()
            stack[-1][1].extend(items)
        items = pop()
        up = stack[-1][1]
        if kind in ("comment", "ref"):
            out.append([(max(n, 0), t) for n, t in items])
            up.append((0, " "))
        elif kind == "link":
            up.extend(_args(items)[-1])
        else:
            args, shown = _args(items)[1:], []
            for a in args:
                m = _ARG_NAME.match(a[0][1]) if a and a[0][0] == 0 else None
                if m:
                    a[0] = (0, a[0][1][m.end() :])
                else:
                    shown.append(a)
            if len(args) > 1 or len(shown) < len(args):
                out.append([p for a in args for p in (*a, (0, " "))])
            up.append((0, " "))
            for k, a in enumerate(shown):
                layer = 1 if k == len(shown) - 1 else 2
                up.extend((max(layer, n), t) for n, t in (*a, (0, " ")))

    for m in _MARK.finditer(text):
        put(text[at : m.start()])
        at, mark = m.end(), m[0]
        ref = mark[:5].lower().lstrip("<")
        if kinds["comment"] and mark != "-->":
            put(" ")  # nothing but its end ends a comment; what is marked up inside it is text
        elif mark in _OPEN:
            push(_OPEN[mark])
        elif mark in _CLOSE:
            close(_CLOSE[mark])
        elif ref[:3] == "ref" and not ref[3:4].isalnum() and not mark.endswith("/>"):
            push("ref")
        elif ref == "/ref" and not mark[5:6].isalnum():
            close("ref")
        else:
            put(" ")
    put(text[at:])
    while len(stack) > 1:
        items = pop()
        stack[-1][1].extend(items)
    out.append([(max(n, 0), t) for n, t in stack[0][1]])
    return out[::-1]


def _plain_words(t: str) -> list[str]:
    if "&" in t:
        t = html.unescape(t)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", _JOIN.sub("", t))
    elif "''" in t:
        t = _JOIN.sub("", t)
    return _WORD.findall(t.casefold())


def _layered(pieces: list[Piece]) -> tuple[list[str], np.ndarray | None]:
    """Words with the layer of each; None if all are 0."""
    if all(n == 0 for n, _ in pieces):
        return _plain_words("".join(t for _, t in pieces)), None
    ws, layers, k = [], [], 0
    while k < len(pieces):
        n, parts = pieces[k][0], []
        while k < len(pieces) and pieces[k][0] == n:
            parts.append(pieces[k][1])
            k += 1
        got = _plain_words("".join(parts))
        ws += got
        layers.append(np.full(len(got), n, np.int8))
    layer = np.concatenate(layers) if layers else np.empty(0, np.int8)
    return ws, layer if layer.any() else None


def words(text: str | None) -> list[str]:
    """The words a text shows, apart from case, punctuation, markup, spacing and line breaks."""
    if not text:
        return []
    ws, layer = _layered(stretches(text)[0])
    return ws if layer is None else [w for w, n in zip(ws, layer.tolist(), strict=True) if n <= 1]


# --- words as codes ----------------------------------------------------------------------------------------------------

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Coder:
    """Words to 64-bit codes: 62 bits of a hash and, in the last two, the type. A literal is a word that some item writes in lower
    case (its bit in ``lexicon`` is set); any other word that is no number or unit is a name. A word's code is a function of the
    word alone, so equal words have equal codes everywhere, whatever the lexicon."""

    #: Different words kept at once.
    ROOM = 1 << 20

    def __init__(self, lexicon: np.ndarray) -> None:
        self.lexicon = lexicon
        self.known: dict[str, int] = {}

    def codes(self, ws: list[str]) -> np.ndarray:
        if len(self.known) > self.ROOM:
            self.known.clear()
        known = self.known
        if new := list(set(ws).difference(known)):
            h = np.fromiter(map(word_hash, new), np.uint64, len(new))
            literal = in_bitmap(self.lexicon, h)
            for w, x, lit in zip(new, h.tolist(), literal.tolist(), strict=True):
                kind = NUM if w in NUMBER_WORDS or any(map(str.isdigit, w)) else UNIT if w in UNITS else LITERAL if lit else NAME
                known[w] = (x & ~3) | kind
        return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


def word_hash(w: str) -> int:
    from xxhash import xxh3_64_intdigest

    return max(xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")), 4)


def template(codes: np.ndarray) -> np.ndarray:
    kind = codes & np.uint64(3)
    return np.where(kind == LITERAL, codes, kind)


def _mixed(c: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = (h ^ c[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h * _MIX


def template_keys(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - WINDOW + 1
    return _mixed(template(codes), n) if n > 0 else np.empty(0, np.uint64)


def bare(codes: np.ndarray) -> np.ndarray:
    """Which windows hold no literal. Such templates are alike everywhere."""
    literal = np.concatenate([[0], np.cumsum(template(codes) > NAME)])
    return literal[WINDOW:] == literal[:-WINDOW]


def window_keys(codes: np.ndarray) -> np.ndarray:
    """The key by which places of both sides meet: that of the window's template, or of its words if it is bare; bare windows that differ in
    words meet by blocks. Which of the two is a function of the window's words, so equal windows have equal keys."""
    n = len(codes) - WINDOW + 1
    return np.where(bare(codes), _mixed(codes, n) ^ _MIX, template_keys(codes)) if n > 0 else np.empty(0, np.uint64)


def around(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16 bits of the keys 1, 5 and 6 places on, packed in one number, and of those before, in another; 0 where there is none."""
    bits = (keys % np.uint64(65535) + np.uint64(1)).astype(np.int64)
    n = len(bits)
    far = np.concatenate([np.zeros(6, np.int64), bits, np.zeros(6, np.int64)])
    at = lambda d: far[6 + d : 6 + d + n]
    return tuple(at(d) | at(5 * d) << 16 | at(6 * d) << 32 for d in (1, -1))


_PACKED = {1: 0, 5: 16, 6: 32}


def supported() -> Column:
    """Whether a shared window of rows (fwd, bwd: the document's; ifwd, ibwd: the item's) counts."""
    part = lambda c, k: F.shiftright(F.col(c), _PACKED[k]).bitwiseAND(F.lit(65535).cast("bigint"))
    same = [(part(d, x) == part(i, y)) & (part(d, x) != 0) for d, i in (("fwd", "ifwd"), ("bwd", "ibwd")) for x, y in STEPS]
    out = same[0]
    for c in same[1:]:
        out = out | c
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set; the bitmap's length gives how many of the hash's first bits count."""
    i = hashes >> np.uint64(65 - len(bitmap).bit_length() - 6)
    return (bitmap[i >> np.uint64(6)] >> (i & np.uint64(63))) & np.uint64(1) == 1


def _one_bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))


def bitmap(hashes: DataFrame, n: int, per: int) -> np.ndarray:
    """A bitmap of the bigint column ``h``, about ``per`` bits for each of n hashes and at most 2^BITMAP_BITS: what reaches the
    driver is its words, whose number is bounded whatever the data."""
    bits = min(BITMAP_BITS, max(12, (per * max(n, 1)).bit_length()))
    place = F.shiftrightunsigned("h", 64 - bits)
    rows = hashes.select(F.shiftright(place, 6).alias("i"), _one_bit(place.bitwiseAND(F.lit(63).cast("bigint"))).alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[np.asarray(rows.column("i"))] = np.asarray(rows.column("b")).view(np.uint64) if rows.num_rows else 0
    return out


# --- both sides as tables of windows -----------------------------------------------------------------------------------


def _lower_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen = {w for t in b.column("text") for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)*", t.as_py()) if w == w.lower() and not w.isdigit()}
        yield pa.RecordBatch.from_arrays([pa.array(np.array([word_hash(w.casefold()) for w in seen], np.uint64).view(np.int64))], names=["h"])


_CODES = pa.list_(pa.int64())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def _item_codes(lexicon):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(lexicon.value)
        for b in batches:
            got = [(i, coder.codes(words(t.as_py()))) for i, t in zip(b.column("item_id").to_pylist(), b.column("text"), strict=True)]
            got = [(i, c) for i, c in got if len(c) >= PASSAGE]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), _lists([c for _, c in got])], names=["item_id", "codes"])

    return f


def _codes_of(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.asarray(c.values).view(np.uint64) for c in b.column("codes")]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of items (w null), and their windows; a window of two segments comes with both, a bare one (bare) by its template too."""
    for b in batches:
        segs, wins = [], []
        for i, c in zip(b.column("item_id").to_pylist(), _codes_of(b), strict=True):
            k, t, none = window_keys(c), template_keys(c), bare(c)
            fwd, bwd = around(t)
            for s in range(max(1, -(-(len(c) - RUN) // SEGMENT))):
                from_, to = s * SEGMENT, s * SEGMENT + REACH
                at = np.arange(from_, min(to, len(k)))
                segs.append((i, s, c[from_:to]))
                wins.append((i, s, at - from_, k[at], fwd[at], bwd[at], False))
                at = at[none[at]]
                wins.append((i, s, at - from_, t[at], fwd[at], bwd[at], True))
        n, size = len(segs), [len(w[2]) for w in wins]
        m = sum(size)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in segs], pa.int64()), pa.array([x[1] for x in segs], pa.int32()), _lists([x[2] for x in segs]), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.int64())] * 3, pa.nulls(n, pa.bool_())], names=_ITEM_NAMES)
        rep = lambda k, t: pa.array(np.repeat(np.array([x[k] for x in wins], t), size))
        cat = lambda k: pa.array(np.concatenate([x[k] for x in wins]).view(np.int64) if wins else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([rep(0, np.int64), rep(1, np.int32), pa.nulls(m, _CODES), cat(2).cast(pa.int32()), cat(3), cat(4), cat(5), rep(6, bool)], names=_ITEM_NAMES)


_ITEM_NAMES = ["item_id", "seg", "codes", "w", "key", "ifwd", "ibwd", "bare"]
_ITEM_DDL = "item_id bigint, seg int, codes array<bigint>, w int, key bigint, ifwd bigint, ibwd bigint, bare boolean"
_DOC_DDL = "kind string, seq bigint, doc_id bigint, key bigint, pos int, fwd bigint, bwd bigint, block int, codes array<bigint>"


def _doc_sequence(text: str, coder: Coder) -> np.ndarray:
    """All word sequences of a document, one behind the other, parted by more words than a run may have added. Where templates may
    show something, their surroundings come again with their last argument and with all of them."""
    parts: list[np.ndarray] = []
    for pieces in stretches(text):
        ws, layer = _layered(pieces)
        if not ws:
            continue
        c = coder.codes(ws)
        if layer is None:
            parts.append(c)
            continue
        parts.append(c[layer == 0])
        for upto in (1, 2):
            if not (layer == upto).any():
                continue
            seen = np.flatnonzero(layer <= upto)
            extra = np.flatnonzero(layer[seen] > 0)
            near = np.zeros(len(seen) + 1, np.int64)
            np.add.at(near, np.maximum(extra - RUN - EDITS, 0), 1)
            np.add.at(near, np.minimum(extra + RUN + EDITS + 1, len(seen)), -1)
            on = np.cumsum(near[:-1]) > 0
            cut = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
            parts += [c[seen[a:b]] for a, b in zip(cut[::2], cut[1::2], strict=True)]
    parts = [p for p in parts if len(p) >= PASSAGE - EDITS]
    gap = np.zeros(EDITS + 1, np.uint64)
    return np.concatenate([x for p in parts for x in (p, gap)]) if parts else np.empty(0, np.uint64)


def _doc_rows(lexicon, wanted):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, keys = Coder(lexicon.value), wanted.value
        seq = TaskContext.get().partitionId() << 40
        for b in batches:
            hits, blocks, meets = [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                seq += 1
                c = _doc_sequence(text.as_py(), coder)
                if len(c) < WINDOW:
                    continue
                t = template_keys(c)
                # a gap has code 0; no window of an item holds it
                on = np.zeros(len(t) + 12, bool)
                on[6 : 6 + len(t)] = in_bitmap(keys, t)
                p = np.flatnonzero(on)
                p = p[on[p + 1] | on[p - 1] | on[p + 5] | on[p - 5] | on[np.minimum(p + 6, len(on) - 1)] | on[p - 6]] - 6
                # the hits of a run lie within RUN + EDITS words
                p = p[np.searchsorted(p, p + RUN + EDITS, "right") - np.searchsorted(p, p - RUN - EDITS) >= LEAST_HITS]
                if not len(p):
                    continue
                alike = p[bare(c)[p]]
                starts, first = np.unique(alike // BLOCK, return_index=True)
                for n, part in zip(starts.tolist(), np.split(t[alike].view(np.int64), first[1:]), strict=False):
                    low = n * BLOCK - BARE_BEFORE
                    blocks.append(("wide", seq, doc, n, c[max(low, 0) : low + REACH + BARE_BAND - 1]))
                    meets += [(seq, doc, x, n) for x in np.unique(part).tolist()]
                k = window_keys(c)[p]
                here = in_bitmap(keys, k)
                k, p = k[here], p[here]
                fwd, bwd = around(t)
                hits.append((seq, doc, k, p, fwd[p], bwd[p]))
                near = np.unique(np.concatenate([np.maximum(p - d, 0) // BLOCK for d in (EDITS, REACH + STRIP + EDITS)]))
                blocks += [("block", seq, doc, n, c[n * BLOCK : (n + 2) * BLOCK]) for n in near.tolist()]
            n, m = sum(len(h[3]) for h in hits), len(blocks)
            size = [len(h[3]) for h in hits]
            rep = lambda x: pa.array(np.repeat(np.array(x, np.int64), size))
            cat = lambda k, t: np.concatenate([h[k] for h in hits]).astype(t) if hits else np.empty(0, t)
            yield pa.RecordBatch.from_arrays([pa.array(["hit"] * n, pa.string()), rep([h[0] for h in hits]), rep([h[1] for h in hits]), pa.array(cat(2, np.uint64).view(np.int64)), pa.array(cat(3, np.int32)), pa.array(cat(4, np.int64)), pa.array(cat(5, np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, _CODES)], names=_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in blocks], pa.string()), pa.array([x[1] for x in blocks], pa.int64()), pa.array([x[2] for x in blocks], pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([x[3] for x in blocks], pa.int32()), _lists([x[4] for x in blocks])], names=_NAMES)
            n = len(meets)
            yield pa.RecordBatch.from_arrays([pa.array(["bare"] * n, pa.string()), *[pa.array([x[j] for x in meets], pa.int64()) for j in range(3)], pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([x[3] for x in meets], pa.int32()), pa.nulls(n, _CODES)], names=_NAMES)

    return f


_NAMES = ["kind", "seq", "doc_id", "key", "pos", "fwd", "bwd", "block", "codes"]


def candidates(hits: DataFrame) -> DataFrame:
    """(seq, item_id, seg, low): the strips of diagonals, from ``low`` on, in which a document shares LEAST_HITS windows that
    count with a segment of an item. hits(seq, pos, item_id, seg, w), w counted within the segment; one partial aggregate, in which
    bit masks count the different places of a segment on both sides."""
    d = F.col("pos") - F.col("w")
    strips = F.explode(F.array(*[(F.floor((d + s) / STRIP) * STRIP - s).cast("int") for s in (0, EDITS)]))
    h = hits.select("seq", "item_id", "seg", "w", "pos", strips.alias("low"))
    bit = lambda c, part: F.bit_or(F.when((c >= 60 * part) & (c < 60 * part + 60), _one_bit(c - 60 * part)).otherwise(F.lit(0).cast("bigint")))
    place = F.col("pos") - F.col("low")
    count = lambda c: F.bit_count(bit(c, 0)) + F.bit_count(bit(c, 1))
    g = h.groupBy("seq", "item_id", "seg", "low").agg(count(F.col("w")).alias("nw"), count(place).alias("np"))
    return g.filter((F.col("nw") >= LEAST_HITS) & (F.col("np") >= LEAST_HITS)).select("seq", "item_id", "seg", "low")


# --- alignment ---------------------------------------------------------------------------------------------------------


def longest_runs(doc: np.ndarray, item: np.ndarray, live: np.ndarray) -> np.ndarray:
    """(levels, n): for each of n pairs the most item words of a run with 0, 1, ... EDITS edits: changed, dropped or added words.

    doc is (n, height + band - 1), item (n, height): item word i stands opposite document words i to i + band - 1, a band of
    diagonals that no run of so few edits leaves; ``live`` is the number of words of each item.
    """
    n, levels, band = len(item), EDITS + 1, doc.shape[1] - item.shape[1] + 1
    # the last column stays 0: there is no diagonal beyond the band
    before, now = np.zeros((levels, n, band + 1), np.int16), np.zeros((levels, n, band + 1), np.int16)
    top, hit, miss = np.zeros((levels, n, band), np.int16), np.empty((n, band), np.int16), np.zeros((n, band), np.int16)
    least = int(live.min(initial=0))
    for i in range(int(live.max(initial=0))):
        same = doc[:, i : i + band] == item[:, i : i + 1]
        for e in range(levels):
            np.add(before[e, :, :band], 1, out=hit)
            out = now[e, :, :band]
            if e:
                np.maximum(before[e - 1, :, :band], before[e - 1, :, 1:], out=miss)
                miss += 1
                np.maximum(miss[:, 1:], now[e - 1, :, : band - 1], out=miss[:, 1:])
                np.copyto(out, miss)
            else:
                out[:] = 0
            np.copyto(out, hit, where=same)
        if i >= least:
            now[:, i >= live] = 0
        np.maximum(top, now[:, :, :band], out=top)
        before, now = now, before
    return top.max(axis=2, initial=0)


def holds(runs: np.ndarray) -> np.ndarray:
    return np.any([runs[e] >= n for n, e in ENOUGH], axis=0)


def may_hold(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Whether so many words of the item in a row stand in the band at all that ``holds`` may be true: a run's words that agree do."""
    band = doc.shape[1] - item.shape[1] + 1
    seen = np.zeros(item.shape, bool)
    for d in range(band):
        seen |= doc[:, d : d + item.shape[1]] == item
    total = np.concatenate([np.zeros((len(item), 1), np.int16), np.cumsum(seen, axis=1, dtype=np.int16)], axis=1)
    return np.any([(total[:, n:] - total[:, :-n] >= n - e).any(axis=1) for n, e in ENOUGH if n < total.shape[1]], axis=0)


#: A step of an alignment: place in the item, place in the document (None where the other side has a word more), and whether the words agree.
Step = tuple[int | None, int | None, bool]


def _onward(item: list[int], doc: list[int], most: int) -> list[list[Step]]:
    """For 0, 1, ... edits, at most ``most``: the alignment from the start of both that takes in the most item words."""
    # by edits: diagonal -> (item words at its entry, after all that agree, diagonal before)
    far: list[dict[int, tuple[int, int, int | None]]] = []
    for e in range(most + 1):
        now = {}
        for k in range(-e, e + 1):
            ways = [(0, None)] if e == 0 else [(far[-1][q][1] + (q >= k), q) for q in (k, k + 1, k - 1) if q in far[-1]]
            ways = [(i, q) for i, q in ways if i <= len(item) and 0 <= i + k <= len(doc)]
            if ways:
                i, q = max(ways, key=lambda w: w[0])
                end = i
                while end < len(item) and end + k < len(doc) and item[end] == doc[end + k]:
                    end += 1
                now[k] = (i, end, q)
        if not now:
            break
        far.append(now)
    out = []
    for e, now in enumerate(far):
        k = max(now, key=lambda q: now[q][1])
        steps: list[Step] = []
        while True:
            i, end, q = far[e][k]
            steps += [(x, x + k, True) for x in range(end - 1, i - 1, -1)]
            if q is None:
                break
            steps.append((i - 1 if q >= k else None, i + k - 1 if q <= k else None, False))
            e, k = e - 1, q
        out.append(steps[::-1])
    return out


def _alignments(item: list[int], doc: list[int], ip: int, dp: int) -> list[list[Step]]:
    """The runs through one pair of places that are long enough for their edits, those of most item words first; a run of more
    edits than ENOUGH has holds a shorter one, so of these only the longest is given."""
    most = len(item) // ONE_IN
    ahead = [[(None if i is None else i + ip, None if j is None else j + dp, s) for i, j, s in p] for p in _onward(item[ip:], doc[dp:], most)]
    behind = [[(None if i is None else ip - 1 - i, None if j is None else dp - 1 - j, s) for i, j, s in reversed(p)] for p in _onward(item[:ip][::-1], doc[:dp][::-1], most)]
    size = lambda p: sum(i is not None for i, _, _ in p)
    a, b = [size(p) for p in ahead], [size(p) for p in behind]
    runs = sorted(((a[x] + b[y], -x - y, x, y) for x in range(len(a)) for y in range(len(b)) if a[x] + b[y] >= max(PASSAGE, ONE_IN * (x + y))), reverse=True)
    return [behind[y] + ahead[x] for k, (_, _, x, y) in enumerate(runs) if not k or x + y <= ENOUGH[-1][1]]


def _longest_allowed(steps: list[Step]) -> list[Step]:
    """The longest part of an alignment that is long enough for its edits; empty if none is."""
    n = np.cumsum([0, *(i is not None for i, _, _ in steps)])
    left = n - ONE_IN * np.cumsum([0, *(not s for _, _, s in steps)])
    best, least = (0, 0), None
    for a in range(len(left)):
        if least is None or left[a] < least:
            least = left[a]
            b = int(np.flatnonzero(left >= least)[-1])
            if n[b] - n[a] > n[best[1]] - n[best[0]]:
                best = (a, b)
    return steps[best[0] : best[1]] if n[best[1]] - n[best[0]] >= PASSAGE else []


def slots(doc: list[int], td: list[int], item: list[int], tt: list[int]) -> tuple[int, int] | None:
    """(placeholders, those with another value) of an aligned run of both templates that holds a passage and has one value for each
    slot of the item; of such runs, the one with the most changed slots. None if there is no such run."""
    at = defaultdict(list)
    hi, hd = (_mixed(np.array(t, np.uint64), len(t) - WINDOW + 1).tolist() for t in (tt, td))
    for w, h in enumerate(hi):
        at[h].append(w)
    most = len({c for c, t in zip(item, tt, strict=True) if t <= NAME})
    best, done = None, set()
    # every passage has windows without an edit; one start for each stretch of them
    for w, p in ((w, p) for p, h in enumerate(hd) for w in at.get(h, ())):
        if w and p and hi[w - 1] == hd[p - 1] or (w, p) in done:
            continue
        if best and best[1] == most:
            break
        for steps in _alignments(tt, td, w, p):
            parts, lo, last = [], 0, {}
            for x, (i, j, same) in enumerate(steps):
                if same and tt[i] <= NAME:
                    before = last.get(item[i])
                    if before and before[1] >= lo and before[0] != doc[j]:
                        parts.append(steps[lo:x])
                        lo = before[1] + 1
                    last[item[i]] = (doc[j], x)
            parts.append(steps[lo:])
            for part in map(_longest_allowed, parts):
                if part:
                    pairs = [(i, j) for i, j, same in part if same]
                    done.update(pairs)
                    values = {item[i]: doc[j] for i, j in pairs if tt[i] <= NAME}
                    changed = sum(v != c for c, v in values.items())
                    if best is None or changed > best[1]:
                        best = (len(values), changed)
            if len(parts) == 1:
                break
    return best


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("verbatim", pa.bool_()), ("changed_slots", pa.int32())])
#: Word pairs of the band that are compared at once.
_CELLS = 1_500_000


def _matrix(lists: pa.Array, start: np.ndarray, width: int, pad: int) -> np.ndarray:
    """Rows of ``width`` codes from each list, from ``start`` on, which may lie outside it."""
    at = np.asarray(lists.offsets)
    flat = np.concatenate([np.asarray(lists.values)[at[0] : at[-1]].view(np.uint64), [np.uint64(0)]])
    at = at - at[0]
    i = start[:, None] + np.arange(width)
    ok = (i >= 0) & (i < np.diff(at)[:, None])
    return np.where(ok, flat[np.where(ok, i + at[:-1, None], 0)], np.uint64(pad))


def _align(band: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, nothing = (1 << 64) - 1, (1 << 64) - 2
        typed = lambda m: np.where(m >= nothing, m, template(m))
        step = max(1, _CELLS // (REACH * band))
        for whole in batches:
            for from_ in range(0, whole.num_rows, step):
                b = whole.slice(from_, step)
                doc = _matrix(b.column("codes"), np.asarray(b.column("at")).astype(np.int64), REACH + band - 1, none)
                item = _matrix(b.column("item_codes"), np.zeros(b.num_rows, np.int64), REACH, nothing)
                td, tt = typed(doc), typed(item)
                # equal words have equal templates
                near = np.flatnonzero(may_hold(td, tt))
                doc, item, td, tt = doc[near], item[near], td[near], tt[near]
                live = np.minimum(np.diff(np.asarray(b.column("item_codes").offsets)), REACH)[near]
                same, changed = np.zeros(len(near), bool), np.zeros(len(near), np.int32)
                own = np.flatnonzero(may_hold(doc, item))
                same[own] = holds(longest_runs(doc[own], item[own], live[own]))
                rest = np.flatnonzero(~same)
                for r in rest[holds(longest_runs(td[rest], tt[rest], live[rest]))].tolist():
                    real = doc[r] != none
                    found = slots(doc[r][real].tolist(), td[r][real].tolist(), item[r][: live[r]].tolist(), tt[r][: live[r]].tolist())
                    changed[r] = found[1] if found else 0
                keep = np.flatnonzero(same | (changed > 0))
                ids = [b.column(c).take(pa.array(near[keep])) for c in ("doc_id", "item_id")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(same[keep]), pa.array(changed[keep])], schema=_OUT)

    return f


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, verbatim, changed_slots) of each document and each item whose template a passage of it has.

    A passage is a run of at least 20 consecutive words of the item, of which at most one in eight is changed, dropped or added.
    ``verbatim`` says that the words themselves make one; else the template does, numbers, units and names standing for each
    other, with one value for each slot along the run, of which ``changed_slots`` differ from the item's (slots are compared
    within 96 words of the item).

    Both sides become typed templates whose windows of five words are hash-joined as two tables. Documents send only windows
    whose key may be an item's (a bitmap of fixed size tells; the join decides) and that lie close enough together for a
    passage, and the words around them in blocks. A shared window counts if the one beside it, or the next behind one edit, is
    shared too (told by 16 bits of their keys). A passage and its copy share LEAST_HITS that count within a strip of diagonals
    of one segment of the item, whatever their edits, since equal windows have equal keys; such strips are counted by a partial
    aggregate and aligned in a band that no such run leaves. Windows without a literal, which would meet everywhere, meet once for
    each block of the document and segment, which are aligned on all their diagonals. So no case is lost, every step on a pair has
    a bounded size, and neither items nor documents are gathered anywhere; a key, document or item that has most rows is split by
    the joins. A text of nothing but names has the template of every item with 20 names in a row.
    Comments, references and templates are texts by themselves and, in the text around them, gaps or what they show.

    Null and short texts on either side give nothing; rows of one doc_id count as one document, of one item_id as one item;
    null ids are left out; empty tables give no rows; columns of other names are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "leaks")
    share = spark.sparkContext.broadcast
    own = lambda d, k: d.select(F.col(k).cast("bigint").alias(k), F.col("text").cast("string").alias("text")).filter(f"{k} is not null and text is not null")
    asked = own(items, "item_id")
    lower = scratch.write(asked.mapInArrow(_lower_words, "h bigint").distinct())
    lexicon = share(bitmap(lower, lower.count(), 1024))
    coded = scratch.write(asked.mapInArrow(_item_codes(lexicon), "item_id bigint, codes array<bigint>"))
    sides = scratch.write(coded.mapInArrow(_item_windows, _ITEM_DDL))
    windows = sides.filter("not bare").select("key", "item_id", "seg", "w", "ifwd", "ibwd")
    alike = sides.filter("bare").select("key", "item_id", "seg").distinct()
    asked_for = sides.filter("w is not null").select(F.col("key").alias("h"))
    wanted = share(bitmap(asked_for, asked_for.count(), 64))
    rows = scratch.write(own(docs, "doc_id").mapInArrow(_doc_rows(lexicon, wanted), _DOC_DDL), ["kind"])
    small = lambda d, width: F.broadcast(d) if fits_broadcast(d, width) else d
    texts = sides.filter("w is null").select("item_id", "seg", F.col("codes").alias("item_codes"))
    texts = small(texts, 8 * REACH + 64)

    def aligned(cand: DataFrame, kind: str, low: Column, band: int) -> DataFrame:
        blocks = rows.filter(F.col("kind") == kind).select("seq", "doc_id", "block", "codes")
        pairs = cand.join(blocks, ["seq", "block"]).join(texts, ["item_id", "seg"])
        return pairs.select("doc_id", "item_id", "codes", low.alias("at"), "item_codes").mapInArrow(_align(band), "doc_id bigint, item_id bigint, verbatim boolean, changed_slots int")

    hits = rows.filter("kind = 'hit'").select("seq", "key", "pos", "fwd", "bwd").join(small(windows, 64), "key").filter(supported())
    cand = scratch.write(candidates(hits)).withColumn("block", F.floor(F.greatest(F.col("low") - EDITS, F.lit(0)) / BLOCK).cast("int"))
    meets = rows.filter("kind = 'bare'").select("seq", "key", "block").join(small(alike, 64), "key").select("seq", "block", "item_id", "seg").distinct()
    each = aligned(cand, "block", F.col("low") - EDITS - BLOCK * F.col("block"), BAND)
    each = each.unionAll(aligned(meets, "wide", F.least(F.col("block") * BLOCK - BARE_BEFORE, F.lit(0)), BARE_BAND))
    return each.groupBy("doc_id", "item_id").agg(F.max("verbatim").alias("verbatim"), F.max("changed_slots").alias("changed_slots"))


def leaked_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the documents and items of ``leaks`` whose words themselves make a passage."""
    return leaks(docs, items).filter("verbatim").select("doc_id", "item_id")


def reparameterised(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, changed_slots): documents that hold a passage's template with other numbers, units or names in its slots,
    each slot's value replaced by one and the same, and not the passage itself."""
    return leaks(docs, items).filter("not verbatim").select("doc_id", "item_id", "changed_slots")
