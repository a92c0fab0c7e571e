"""Language-model scores by online logistic context mixing.

A text is a run of tokens: its words (A-Z lower-cased), then one end. The tokens are
turned into bits, in the text's order, and the model gives every bit a probability
from what came before it, so the product over a text is a proper probability.

* Bits. Words that training has three times or more have a prefix code: the binary
  expansion of their place in the line of all training tokens (Shannon, Fano and Elias),
  about log2(N / count) bits. All others begin with an escape code. Then words seen once
  or twice are picked from their list, with a share by their count; new words are spelled:
  their bytes and a space, each byte as the bits of a prefix code. While the model learns,
  a word's own occurrence doesn't count: one seen twice is on the list, one seen once is
  new. So it meets rare and new words as often as new texts do, and how often an escape
  leads to the list comes from these counts (Good and Turing).
* Predictors. Hashed contexts look up how often a bit was 0 and 1 in training. For a
  word's code: none, the word before, the last bytes before the blank, and the last
  frequent word. For a spelled byte: the last 1, 2, 3 and 4 bytes,
  running over the blank into the word before; the word so far; and the last frequent
  word with the last 2 bytes.
* Gated weights. The stretched predictions are combined by a logistic mixer, whose
  weight vector is picked by how often the longest contexts were seen and by the depth
  in the code.
* Refinement. A table over (gate, mixed probability) holds what really happened where
  the mixer said so; the final probability is half way to it.
* Adaptation. Within a text, the model's probability of a word is mixed with the words
  of the text so far, then with those that followed the same word in it, at several
  strengths weighted by how well each has done in the text.

Weights and refinement are learned online, in steps over all training texts, each bit
predicted from counts without the very occurrence that is being predicted. Tasks learn
side by side and their weights are averaged by the bits seen. Words, counts, contexts,
weights and refinement all come from all training texts.

1. One pass turns blocks of texts into word numbers and dictionaries, whose words are
   dealt to parts by their hash; the number of parts follows the bytes of the input.
2. Each part counts its words over all blocks and lays them on its stretch of the line.
3. Blocks get counts and places back and write their texts as codes.
4. Over the coded texts: counts of bits by context, weights, scores; texts don't meet.

The code book holds every word of the corpus and grows with it; it is never collected,
only one row for each part is. The context tables are broadcast; their size follows the
training tokens up to ``MOST_BITS``, beyond which contexts share slots.

Defined cases: null and empty texts are one end token; a null id counts as training;
repeated rows are learned from and scored each; very long texts and words are worked
off in slices; other columns are ignored, whatever their names; an empty table gives an
empty result; with nothing to learn from, every bit has probability one half. Reruns
over the same files agree; another split into tasks changes the learned weights a little.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.words import LOWER, chunks, mix, texts_of
from quire.session import written

FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 16 << 20
#: Bytes of text for each part of the vocabulary.
PART_BYTES = 32 << 20
#: log2 of the slots of the predictors' tables at most: of words (no context, word before, last bytes, frequent word) ...
WORD_BITS = (20, 20, 19, 20)
#: ... and of spelled bytes (orders 1 to 4, word so far, frequent word and order 2).
BYTE_BITS = (16, 18, 19, 19, 19, 19)
#: Bits of a word's code from this depth on are predicted without context.
DEEP = 14
#: Bits in a row whose slots of a context lie in one aligned group of 2**GROUP, one line of the processor's cache.
GROUP = 3
#: Words seen at most so often have no code of their own; what stands for a length in theirs.
RARE = 2
NEW, TWICE, ONCE = np.uint64(61), np.uint64(62), np.uint64(63)
CHUNK = 1 << 16
#: Partial tables that one merge takes at a time.
FAN = 64
WORDS, REST, BYTES = range(3)
#: By mixer: its tables (of words and bytes together) and gates.
INPUTS = ((0, 1, 2, 3), (0,), (4, 5, 6, 7, 8, 9))
GATES = (4 * 3 * 3, 4, 4 * 3 * 2)
#: From how often a context was seen to a part of the gate, by table: the cuts, and what one step counts in the gate.
SEEN = {0: ((0.5, 7.5, 63.5), 1), 1: ((0.5, 7.5, 63.5), 9), 2: ((0.5, 63.5), 3), 7: ((0.5, 7.5), 2), 8: ((0.5, 3.5, 31.5), 6)}
#: The lowest bits of a slot's stretched prediction are its part of the gate; they change it by less than 1e-5 of it.
PART = np.uint8(31)
#: By mixer: the inputs whose parts make the gate.
GATED = ((1, 2), (0,), (4, 3))
BINS = 33
PRIOR = 0.15
RATE = 0.08
#: Words whose code is at most this long tell the language of what follows.
FREQUENT = 10
#: Words, and bytes of spelled words, of a step, and of an online step of learning.
STEP, LEARN_STEP = (1 << 16, 1 << 13), (1 << 13, 1 << 11)
#: Bytes of codes that are counted or scored at a time; what belongs to them stays in the processor's cache.
CODES = 8 * STEP[0]
#: Tokens that are adapted at a time, or one text's.
ADAPTED = 1 << 14
#: Pseudo-tokens of the model in the adaptation to a text.
STRENGTHS = (15.0, 150.0, 3000.0)
#: The same for the words that followed the same word.
AFTER = (1.0, 10.0, 1000.0)
ZSTD = pa.Codec("zstd", 1)
BLANKS = b" \t\n\x0b\x0c\r"
ODD = np.uint64(0x9E3779B97F4A7C15)
NODE = np.uint64(0xD6E8FEB86659FD93)


def planes(x: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then the next ones and so on, which compress better than whole numbers."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def numbers(x: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


# --- step 1: blocks ---------------------------------------------------------------------------

BLOCKS = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("numbers", pa.binary()), ("n_bytes", pa.int64()),
    ("part", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()),
])
BLOCK_TYPES = "block bigint, doc_id bigint, held_out boolean, numbers binary, n_bytes bigint, part bigint, words binary, counts binary"


_BLANK = np.isin(np.arange(256), list(BLANKS))


def _array(at: np.ndarray, data: bytes) -> pa.Array:
    """Words whose n + 1 offsets in ``data`` are ``at``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])


def _split(words: bytes) -> pa.Array:
    """What ``words.split(b" ")`` lists."""
    ends = np.append(np.flatnonzero(np.frombuffer(words, np.uint8) == 32), len(words))
    return _array(np.insert(ends - np.arange(len(ends)), 0, 0), words.replace(b" ", b""))


def _numbered(words: list[pa.Array]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct words in the order in which they first come, and by array which of them its words are."""
    coded = pa.chunked_array(words, pa.large_binary()).dictionary_encode()
    if not coded.num_chunks:
        return [], []
    found = coded.chunk(0).dictionary
    at = np.frombuffer(found.buffers()[1], np.int64)[found.offset :][: len(found) + 1].tolist()
    data = found.buffers()[2]
    data = data.to_pybytes() if data else b""  # cut by hand, as to_pylist() takes several times as long
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)], [c.indices.to_numpy() for c in coded.chunks]


def _tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of the texts end to end, A-Z lower-cased, with an empty one at each text's end, and by text how many tokens and bytes of words."""
    data = b"\n".join([*texts, b""]).translate(LOWER)
    blank = np.concatenate([[True], _BLANK[np.frombuffer(data, np.uint8)]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    first, length = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    words = np.searchsorted(first, ends)
    at = np.zeros(len(length) + len(texts) + 1, np.int64)
    np.cumsum(np.insert(length, words, 0), out=at[1:])
    flat = _array(at, data.translate(None, BLANKS))
    last = words + np.arange(1, len(texts) + 1)
    return flat, np.diff(last, prepend=0), np.diff(at[last], prepend=0)


def _blocks(n_parts: int):
    """Texts (block, doc_id, held_out, numbers, n_bytes) and, by part, words with their training counts of each block.

    A block's words are numbered in the order of their parts.
    """

    def flush(block, tokens, lengths, doc_ids, held, sizes) -> Iterator[pa.RecordBatch]:
        length = np.array(lengths, np.int64)
        words, each = _numbered(tokens)
        flat = np.concatenate(each)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        part = ((h >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((-np.bincount(flat, minlength=len(words)), part))
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        number = rank[flat]
        train = np.bincount(number[np.repeat(~np.array(held), length)], minlength=len(words)).astype(np.int64)
        ends, rows = np.cumsum(length).tolist(), len(lengths)
        for a in range(0, rows, 4096):
            b = min(a + 4096, rows)
            parts = [planes(number[e - k : e]) for e, k in zip(ends[a:b], lengths[a:b], strict=True)]
            none = [pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.binary()), pa.nulls(b - a, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * (b - a)), pa.array(doc_ids[a:b], pa.int64()), pa.array(held[a:b]), pa.array(parts, pa.binary()), pa.array(sizes[a:b]), *none],
                schema=BLOCKS,
            )
        of = part[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
        spans = [slice(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        at, n = order.tolist(), len(spans)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block] * n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(of[cut[:-1]]),
                pa.array([b" ".join([words[i] for i in at[s]]) for s in spans], pa.binary()), pa.array([planes(train[s]) for s in spans], pa.binary()),
            ], schema=BLOCKS,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 24
        state, size = [[] for _ in range(5)], 0
        for batch in chunks(batches, "text"):
            texts = texts_of(batch, "text")
            tokens, lengths, n_bytes = _tokens(texts)
            for column, x in zip(state, ([tokens], lengths.tolist(), batch.column(0).to_pylist(), map(bool, batch.column(1).to_pylist()), (n_bytes + lengths).tolist()), strict=True):
                column.extend(x)
            size += sum(map(len, texts))
            if size > BLOCK_BYTES:
                yield from flush(block, *state)
                block, state, size = block + 1, [[] for _ in range(5)], 0
        if state[0]:
            yield from flush(block, *state)

    return run


# --- step 2: counts of words and their places on the line ------------------------------------

PLACE_TYPES = "block bigint, part bigint, totals binary, places binary, spelled binary, tails binary, tokens bigint, known bigint, once bigint, twice bigint, mass bigint"


def _tail(word: bytes) -> int:
    """16 bits of the last three bytes."""
    return xxhash.xxh32_intdigest(word[-3:]) & 0xFFFF


class Tails(dict):
    """The last three bytes of a word -> their 16 bits."""

    def __missing__(self, end: bytes) -> int:
        value = self[end] = _tail(end)
        return value


def _count_part(table: pa.Table) -> pa.Table:
    """For each block's words of a part: training count, place on the part's line and, of words to be spelled, the bytes."""
    table = table.sort_by("block")
    each, words = _numbered([_split(x) for x in table["words"].to_pylist()])
    counts = [numbers(x, np.int64) for x in table["counts"].to_pylist()]
    total = np.bincount(np.concatenate(words), np.concatenate(counts), len(each)).astype(np.int64)
    coded = np.where(total > RARE, total, 0)
    place = np.where(total > RARE, np.cumsum(coded) - coded, np.arange(len(total)))  # rare words: a number within the part
    tails = Tails()
    tail = np.fromiter((tails[w[-3:]] for w in each), np.uint16, len(each))
    sums = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum()), int(coded.sum())]
    rows = [
        (planes(total[w]), planes(place[w]), b" ".join([each[i] for i in w[total[w] < 2].tolist()]), planes(tail[w]), *sums) for w in words
    ]
    kinds = [*[pa.binary()] * 4, *[pa.int64()] * 5]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.table([table["block"], table["part"], *columns], names=[x.split()[0] for x in PLACE_TYPES.split(", ")])


def codes_of(place: np.ndarray, count: np.ndarray, total: int) -> np.ndarray:
    """The code of the stretch [place, place + count) of a line of ``total`` tokens: bits << 6 | length.

    The length is the first with count * 2**(length - 1) >= total; the bits are those of the middle.
    """
    length = np.ones(len(place), np.int64)
    reach = count.astype(np.float64)
    while (short := reach < total).any():
        length[short] += 1
        reach[short] *= 2
    x, bits = 2 * place + count, np.zeros(len(place), np.uint64)
    for i in range(int(length.max()) if len(place) else 0):
        live = i < length
        x = np.where(live, 2 * x, x)
        one = live & (x >= 2 * total)
        x = np.where(one, x - 2 * total, x)
        bits = np.where(live, bits << np.uint64(1) | one.astype(np.uint64), bits)
    return bits << np.uint64(6) | length.astype(np.uint64)


# --- step 3: coded texts ----------------------------------------------------------------------

CODED_TYPES = (
    "doc_id bigint, held_out boolean, n_bytes bigint, n_tokens bigint, n_known bigint, base_score double, codes binary, tails binary, spelled binary"
)


class Book:
    """What the code of every word depends on: where the parts start on the line, and totals."""

    def __init__(self, parts: list):
        parts = sorted(parts, key=lambda r: r.part)
        self.base, at = {}, 0
        for r in parts:
            self.base[r.part] = at
            at += r.mass
        total = lambda c: sum(getattr(r, c) for r in parts)
        self.tokens, self.known, once, twice = map(total, ("tokens", "known", "once", "twice"))
        rare = max(1, once + 2 * twice)
        self.total = at + rare
        self.escape = codes_of(np.array([at]), np.array([rare]), self.total)[0]
        # One more of each, so that neither way is impossible.
        listed = (2 * twice + 1) / (once + 2 * twice + 2)
        #: ln P after an escape: of any new word, and of one word seen once or twice.
        self.new = math.log(1 - listed)
        self.listed = [math.log(listed) + math.log(c / rare) for c in (1, 2)]


def _code_texts(book: Book):
    names = [x.split()[0] for x in CODED_TYPES.split(", ")]

    def run(words: pa.Table, texts: pa.Table) -> pa.Table:
        words = words.sort_by("part")
        join = lambda c, kind: np.concatenate([numbers(x, kind) for x in words[c].to_pylist()] or [np.zeros(0, kind)])
        total, place, tail = join("totals", np.int64), join("places", np.int64), join("tails", np.uint16)
        sizes = [len(x) // 8 for x in words["totals"].to_pylist()]
        spelled = [w for x, t in zip(words["spelled"].to_pylist(), words["totals"].to_pylist(), strict=True) if (numbers(t, np.int64) < 2).any() for w in x.split(b" ")]
        spells = total < 2
        nth = np.cumsum(spells) - 1
        rare = np.repeat(words["part"].to_numpy(), sizes).astype(np.uint64) << np.uint64(24) | place.astype(np.uint64)
        code = np.where(total == 0, NEW, rare << np.uint64(6) | np.where(total == 1, ONCE, TWICE))
        common = total > RARE
        place = place + np.repeat([book.base[p] for p in words["part"].to_pylist()], sizes).astype(np.int64)
        code[common] = codes_of(place[common], total[common], book.total)
        base = np.log10((total + 1) / (book.tokens + book.known + 1))
        # By word, in this order: the bytes of code and tail as planes() lays them, and two flags.
        of_word = np.ascontiguousarray(np.concatenate([x.view(np.uint8).reshape(len(x), -1).T for x in (code, tail, total > 0, spells)]))
        rows: list[tuple] = []
        for x in texts["numbers"].to_pylist():
            at = numbers(x, np.uint32).astype(np.intp)
            own = of_word.take(at, axis=1, mode="clip")
            out = b"".join([spelled[i] + b" " for i in nth[at[own[11].view(bool)]].tolist()])
            rows.append((len(at), np.count_nonzero(own[10]), float(base[at].sum()), own[:8].tobytes(), own[8:10].tobytes(), out))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.large_binary(), pa.large_binary(), pa.large_binary())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        columns = [c.cast(pa.binary()) if c.type == pa.large_binary() else c for c in columns]
        return pa.table([texts["doc_id"], texts["held_out"], texts["n_bytes"], *columns], names=names)

    return run


# --- bits and contexts ------------------------------------------------------------------------


class Code:
    """A prefix code for bytes: node and bit of each step, from byte counts (every byte counts once more)."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        children: dict[int, tuple[int, int]] = {}
        nxt = 256
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            children[nxt] = (x, y)
            heapq.heappush(heap, (a + b, nxt))
            nxt += 1
        steps: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        todo = [(heap[0][1], [])]
        while todo:
            node, path = todo.pop()
            if node < 256:
                steps[node] = path
            else:
                for bit, child in enumerate(children[node]):
                    todo.append((child, [*path, (node, bit)]))
        self.length = np.array([len(s) for s in steps], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.node = np.array([n for s in steps for n, _ in s], np.uint64)
        self.bit = np.array([b for s in steps for _, b in s], np.int8)
        #: By step: the node that its group starts from, and its place in the group.
        self.root = np.array([s[i - i % GROUP][0] for s in steps for i in range(len(s))], np.uint32)
        self.place = np.array([_place([b for _, b in s[i - i % GROUP : i]]) for s in steps for i in range(len(s))], np.uint32)


def _place(bits: list[int]) -> int:
    """The place in its group of the step after these of the group's bits: 1, then 2 and 3, then 4 to 7."""
    return int("".join(map(str, [1, *bits])), 2)


class Bits:
    """Bits of a step: the mixer they belong to, value, token, slot in each of the mixer's tables, and a number about their depth.

    While the model learns, twice the slot plus the bit stands for the slot. ``first``: of words' codes the first bits;
    the owners of the deeper bits that follow are the first ones of theirs.
    """

    def __init__(self, kind: int, bit: np.ndarray, owner: np.ndarray, slots: list[np.ndarray], depth, first: bool = False):
        self.kind, self.bit, self.owner, self.slots, self.depth, self.first = kind, bit, owner, slots, depth, first


def _slot(context: np.ndarray, node: np.ndarray, bits: int, start: int) -> np.ndarray:
    h = context + node
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - bits)
    h += np.uint32(start)
    return h


def _shifted(x: np.ndarray, first: np.ndarray, by: int) -> np.ndarray:
    """``x`` of the token ``by`` places before, 0 before the text's start; ``first``: where each token's text starts."""
    out = np.zeros_like(x)
    out[by:] = x[: len(x) - by]
    out[np.arange(len(x)) - first < by] = 0
    return out


def _short(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> np.uint64(32)).astype(np.uint32)


class Texts:
    """Coded texts end to end, with the contexts of every token."""

    def __init__(self, codes: list[bytes], tails: list[bytes], spelled: list[bytes], shape: Shape, learning: bool):
        self.shape, self.learning = shape, learning
        self.v = np.concatenate([numbers(x, np.uint64) for x in codes])
        self.lengths = np.array([len(x) // 8 for x in codes], np.int64)
        words = [w for x in spelled if x for w in x[:-1].split(b" ")]
        kind = self.v & np.uint64(63)
        spells = np.flatnonzero((kind == NEW) | (kind == ONCE))  # these have their bytes in ``spelled``
        novel = kind[spells] == (ONCE if learning else NEW)
        self.novel, self.words = spells[novel], words if novel.all() else [w for w, n in zip(words, novel.tolist(), strict=True) if n]
        #: ln P of what follows an escape beside spelled bytes.
        self.extra = np.zeros(len(self.v))
        for k, x in ((NEW, shape.book.new), (ONCE, shape.book.listed[0]), (TWICE, shape.book.listed[1])):
            self.extra[kind == k] = x
        self.code = np.where(kind >= NEW, shape.book.escape, self.v)
        n = len(self.v)
        first = np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.ident = self.v.copy()
        if not learning:
            self.ident[self.novel] = np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 << 63 for w in self.words), np.uint64, len(self.words))
        before = _shifted(self.ident, first, 1)
        self.tail = _shifted(np.concatenate([numbers(x, np.uint16) for x in tails]).astype(np.uint64), first, 1)
        frequent = np.where((self.v & np.uint64(63)) <= FREQUENT, np.arange(n), -1)
        last = np.concatenate([[-1], np.maximum.accumulate(frequent)[:-1]]) if n else frequent
        self.frequent = np.where(last >= first, self.v[np.maximum(last, 0)], 0).astype(np.uint64)
        self.contexts = [
            _short(before + np.uint64(11)), _short(self.tail + np.uint64(17 << 20)), _short(self.frequent + np.uint64(19 << 40)),
        ]

    def steps(self, step: tuple[int, int] = STEP) -> Iterator[Bits]:
        for a in range(0, len(self.v), step[0]):
            yield from self._words(a, min(a + step[0], len(self.v)))
        size = np.fromiter((len(w) + 1 for w in self.words), np.int64, len(self.words))
        for a, b in _cut(size, step[1]):
            yield self._bytes(self.words[a:b], self.novel[a:b])

    def _words(self, a: int, b: int) -> Iterator[Bits]:
        """Codes depth by depth; with the longest first, the words that still have bits are a prefix."""
        length = (self.code[a:b] & np.uint64(63)).astype(np.uint8)
        order = np.argsort(np.uint8(63) - length, kind="stable")
        owner, length = order + a, length[order]
        # The codes with their first bit uppermost; their upper halves do until depth 31.
        whole = (self.code[owner] >> np.uint64(6)) << (np.uint64(64) - length.astype(np.uint64))
        upper = (whole >> np.uint64(32)).astype(np.uint32)
        contexts = [c[owner] for c in self.contexts]
        bits, start = self.shape.bits, self.shape.start
        live = np.searchsorted(-length.astype(np.int64), -np.arange(int(length[0])), side="left") if len(length) else []
        half, deep, learning = 1 << (bits[0] - 1), [], np.uint32(self.learning)
        for depth, n in enumerate(np.asarray(live).tolist()):
            if depth < 31:
                top = (upper[:n] >> np.uint32(32 - depth)) if depth else np.zeros(n, np.uint32)
                bit = (upper[:n] >> np.uint32(31 - depth)).astype(np.uint8) & np.uint8(1)
                node = top + np.uint32(1 << depth)
            else:
                node = (whole[:n] >> np.uint64(64 - depth)) + np.uint64(1 << depth)
                bit = (whole[:n] >> np.uint64(63 - depth)).astype(np.uint8) & np.uint8(1)
            if 1 << (depth + 1) <= half:
                slot = node
            else:
                slot = (np.uint64(half) + (mix(node.astype(np.uint64)) >> np.uint64(65 - bits[0]))).astype(np.uint32)
            if learning:
                slot = slot << learning | bit
            if depth < self.shape.deep:
                into = depth % GROUP
                if not into:
                    small = node * np.uint32(0x85EBCA6B)
                    groups = [_slot(c[:n], small, bits[i], start[i]) << learning for i, c in enumerate(contexts, 1)]
                place = node & np.uint32((1 << into) - 1) | np.uint32(1 << into)
                if learning:
                    place = place << learning | bit
                yield Bits(WORDS, bit, owner[:n], [slot, *(g[:n] ^ place for g in groups)], (depth >= 4) + (depth >= 9), not depth)
            else:
                deep.append((bit, owner[:n], slot))
        if deep:
            bit, owner, slots = map(np.concatenate, zip(*deep, strict=True))
            yield Bits(REST, bit, owner, [slots], 0)

    def _bytes(self, words: list[bytes], owner: np.ndarray) -> Bits:
        data = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(data)) - starts[row]
        b = data.astype(np.uint64)
        power = np.cumprod(np.concatenate([[1], np.full(int(lengths.max()), ODD, np.uint64)]), dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * power[place], dtype=np.uint64)])
        so_far = mix(sums[:-1] - sums[starts][row])
        over = so_far * ODD + self.tail[owner][row]  # the bytes so far and, over the blank, the word before
        last, contexts = np.zeros(len(data), np.uint64), []
        for k in range(1, 5):
            prev = np.zeros(len(data), np.uint64)
            prev[k:] = b[: len(b) - k]
            last = last * np.uint64(257) + prev + np.uint64(1)
            contexts.append(np.where(place >= k, last, over) + np.uint64(k << 56))
        two = np.where(place >= 2, prev_bytes(b, 2), over)
        contexts += [so_far, self.frequent[owner][row] * ODD + two]
        code = self.shape.code
        steps = code.length[data]
        byte = np.repeat(np.arange(len(data)), steps)
        within = np.arange(len(byte)) - (np.cumsum(steps) - steps)[byte]
        at = code.start[data][byte] + within
        root, place, bit, learning = code.root[at] * np.uint32(0x85EBCA6B), code.place[at], code.bit[at].astype(np.uint8), np.uint32(self.learning)
        if learning:
            place = place << learning | bit
        bits, start, n = self.shape.bits, self.shape.start, len(self.shape.words)
        slots = [_slot(_short(c)[byte], root, bits[n + i], start[n + i]) << learning ^ place for i, c in enumerate(contexts)]
        return Bits(BYTES, bit, owner[row[byte]], slots, (within > 0).astype(np.uint8))


def prev_bytes(b: np.ndarray, k: int) -> np.ndarray:
    """The k bytes before each place as one number; 0 where fewer come before."""
    out = np.zeros(len(b), np.uint64)
    for j in range(1, k + 1):
        out[j:] = out[j:] * np.uint64(257) + b[: len(b) - j]
    return out


def _cut(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose sizes add up to about ``limit``, one place at least."""
    total, at = np.cumsum(size), 0
    while at < len(size):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield at, end
        at = end


# --- step 4: counts, weights, scores ----------------------------------------------------------


class Shape:
    """Table sizes that follow the training tokens, the byte code and the code book's totals."""

    def __init__(self, book: Book, code: Code):
        most = max(12, math.ceil(math.log2(book.tokens + 1)) + 1)
        self.words, self.bytes = tuple(min(b, most) for b in WORD_BITS), tuple(min(b, most) for b in BYTE_BITS)
        self.bits = (*self.words, *self.bytes)
        self.book, self.code, self.deep = book, code, DEEP
        ends = np.cumsum([1 << b for b in self.bits])
        self.start, self.size = [0, *ends[:-1].tolist()], int(ends[-1])

    def texts(self, batch: pa.RecordBatch, learning: bool = False) -> Texts:
        get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
        return Texts(get("codes"), get("tails"), get("spelled"), self, learning)


def _count_bits(shape: Shape):
    """Slices of (times 0, times 1) of all slots, end to end: what the task's texts add to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_ = np.zeros(2 * shape.size, np.uint32), False
        one = np.uint32(1)
        for batch in chunks(batches, "codes", CODES):
            any_ = True
            for bits in shape.texts(batch, learning=True).steps():
                for s in bits.slots:
                    np.add.at(counts, s.astype(np.int64), one)
        if any_:
            counts = np.ascontiguousarray(counts.reshape(-1, 2).T).reshape(-1)
            context = TaskContext.get()
            who = context.partitionId() if context else 0
            for c in range(-(-len(counts) // CHUNK)):
                part = counts[c * CHUNK : (c + 1) * CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([who], pa.int64()), pa.array([_packed(part)], pa.binary())], ["chunk", "who", "counts"])

    return run


COUNT_TYPES = "chunk bigint, who bigint, counts binary"


def _packed(counts: np.ndarray) -> bytes:
    """A slice of whole numbers: their lowest bytes, then places and values of those that don't fit a byte."""
    large = np.flatnonzero(counts > 255)
    data = counts.astype(np.uint8).tobytes() + planes(np.concatenate([large, counts[large].astype(np.int64)]))
    return ZSTD.compress(data, asbytes=True) + len(counts).to_bytes(4, "little") + len(large).to_bytes(4, "little")


def _slice(x: bytes) -> np.ndarray:
    size, n = int.from_bytes(x[-8:-4], "little"), int.from_bytes(x[-4:], "little")
    data = ZSTD.decompress(x[:-8], size + 16 * n, asbytes=True)
    counts = np.frombuffer(data, np.uint8, size).astype(np.int64)
    large = numbers(data[len(counts) :], np.int64)
    counts[large[:n]] = large[n:]
    return counts


def _merge(table: pa.Table) -> pa.Table:
    total = sum(_slice(x.as_py()) for x in table["counts"])
    who = table["who"][0].as_py() // FAN
    return pa.table({"chunk": table["chunk"].slice(0, 1), "who": pa.array([who], pa.int64()), "counts": pa.array([_packed(total)], pa.binary())})


#: By bit: what makes a stretched probability of a one into that of the other bit.
SIGN = np.array([1, -1], np.float32)


def _scaled(z: np.ndarray) -> np.ndarray:
    """Places among the refinement's bins, in parts of a bin."""
    u = np.clip(z, np.float32(-7.999), np.float32(7.999))
    u += np.float32(8)
    u *= np.float32((BINS - 1) / 16)
    return u


class Mixer:
    """Gated weights and the refinement over some of the tables."""

    def __init__(self, kind: int):
        self.kind, self.n, self.gates = kind, len(INPUTS[kind]), GATES[kind]
        self.weights = np.full((self.n + 1, self.gates), 0.3, np.float32)
        self.weights[self.n] = 0
        self.refine: np.ndarray | None = None
        self.squares = np.zeros((self.n + 1, self.gates))
        self.stats = np.zeros((2, 2 * self.gates * BINS))  # by gate, bin and bit: how many, and what of them goes to the next bin
        self.mass = 0.0

    def inputs(self, bits: Bits, stretched: np.ndarray) -> tuple[np.ndarray, np.ndarray, slice]:
        """The bits' inputs by row, each bit's gate as its place among those that the depth leaves, and these gates."""
        x = np.empty((self.n + 1, len(bits.bit)), np.float32)
        for i, s in enumerate(bits.slots):
            stretched.take(s, mode="clip", out=x[i])
        x[self.n] = 0.3
        first, *more = (x[k].view(np.uint32).astype(np.uint8) & PART for k in GATED[self.kind])
        gate = sum(more, first)
        if self.kind == WORDS:  # the depth is the same for all
            return x, gate // np.uint8(3), slice(bits.depth, None, 3)
        return x, gate + np.uint8(bits.depth), slice(None)

    @staticmethod
    def mixed(weights: np.ndarray, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        gate = gate.astype(np.intp)
        z = weights[-1].take(gate, mode="clip")
        z *= x[-1]
        for i in range(len(x) - 1):
            w = weights[i].take(gate, mode="clip")
            w *= x[i]
            z += w
        return z

    def learn(self, bits: Bits, stretched: np.ndarray) -> None:
        """One online step: predict, note what happened for the refinement, then follow the gradient."""
        x, gate, gates = self.inputs(bits, stretched)
        weights, squares = self.weights[:, gates], self.squares[:, gates]
        z = np.clip(self.mixed(weights, x, gate), -14, 14)
        u = _scaled(z)
        place = np.floor(u)
        u -= place
        at = place.astype(np.int32)
        at += gate * np.int32(BINS)
        at <<= np.int32(1)
        at += bits.bit
        n, size = weights.shape[1], 2 * BINS * weights.shape[1]
        seen = np.bincount(at, minlength=size).reshape(n, -1)
        stats = self.stats.reshape(2, self.gates, -1)[:, gates]
        stats[0] += seen
        stats[1] += np.bincount(at, u, size).reshape(n, -1)
        error = np.exp(np.negative(z, out=z), out=z)
        error += np.float32(1)
        np.divide(np.float32(1), error, out=error)
        error -= bits.bit
        x *= error
        # By input and gate, as a product with which gate each bit has.
        g = x @ (gate == np.arange(n, dtype=np.uint8)[:, None]).astype(np.float32).T / np.maximum(seen.sum(1), 1)
        squares += g * g
        weights -= (RATE * g / np.sqrt(squares + 1e-6)).astype(np.float32)
        self.mass += len(z)

    def cost(self, bits: Bits, stretched: np.ndarray) -> np.ndarray:
        """-ln P of each bit."""
        x, gate, gates = self.inputs(bits, stretched)
        z = self.mixed(self.weights[:, gates], x, gate)
        np.clip(z, -14, 14, out=z)
        if self.refine is not None:
            u = _scaled(z)
            at = u.astype(np.int32)
            at += gate * np.int32(BINS)
            base, slope = (t[gates].reshape(-1) for t in self.lines)
            u *= slope.take(at, mode="clip")
            z *= np.float32(0.5)
            z += base.take(at, mode="clip")
            z += u
        z *= SIGN.take(bits.bit)
        return np.log1p(np.exp(z, out=z), out=z)

    def packed(self) -> np.ndarray:
        n, upper = self.stats.reshape(2, -1, 2)
        bins = n - upper
        bins[1:] += upper[:-1]
        return np.concatenate([self.weights.ravel().astype(np.float64) * self.mass, bins.sum(1), bins[:, 1], [self.mass]])

    def learned(self, values: np.ndarray) -> None:
        """Take weights and refinement from the sum of what tasks have ``packed``."""
        k = self.gates * (self.n + 1)
        mass = values[-1]
        if not mass:
            self.weights[:] = 0
            return
        self.weights = (values[:k].reshape(self.n + 1, -1) / mass).astype(np.float32)
        seen, ones = values[k:-1].reshape(2, -1)
        centre = np.tile(np.arange(BINS) * 16 / (BINS - 1) - 8, self.gates)
        p = (ones + 4 / (1 + np.exp(-centre))) / (seen + 4)
        self.refine = np.log(p / (1 - p)).astype(np.float32)
        # Half the refinement as a line from each bin to the next.
        low = 0.5 * np.log(p / (1 - p)).reshape(-1, BINS)
        slope = np.diff(low, append=low[:, -1:])
        self.lines = (low - slope * np.arange(BINS)).astype(np.float32), slope.astype(np.float32)


class Model:
    """The mixers over the table: codes of words, their deep bits, and bytes of spelled words."""

    def __init__(self, shape: Shape, counts: np.ndarray):
        self.shape = shape
        self.zeros, self.ones = counts[: shape.size], counts[shape.size : 2 * shape.size]
        self.mixers = [Mixer(k) for k in range(3)]
        self.stretched: np.ndarray | None = None

    def prepare(self, learning: bool = False) -> None:
        """Stretched predictions of all slots, with their gate parts in the lowest bits.

        While the model learns, a bit's own occurrence doesn't count: by slot, what it says to bits that are 0 and to those that are 1.
        """
        size, prior, own = self.shape.size, np.float32(PRIOR), np.float32(learning)
        self.stretched = np.empty(size * (1 + learning), np.float32)
        by_bit = self.stretched.reshape(size, -1).T
        for i, (first, n) in enumerate(zip(self.shape.start, self.shape.bits, strict=True)):
            at = slice(first, first + (1 << n))
            zeros, ones = self.zeros[at], self.ones[at]
            said = [np.log((ones + prior) / (np.maximum(zeros - own, 0) + prior))]
            if learning:
                said.append(np.log((np.maximum(ones - own, 0) + prior) / (zeros + prior)))
            if i in SEEN:
                cuts, step = SEEN[i]
                total = zeros + ones - own
                part = sum((total >= c).view(np.uint8) for c in cuts) * np.uint8(step)
                for x in said:
                    x.view(np.uint32)[:] = x.view(np.uint32) & ~np.uint32(PART) | part
            for x, y in zip(by_bit, said, strict=True):
                x[at] = y

    def learn(self, texts: Texts) -> None:
        for bits in texts.steps(LEARN_STEP):
            self.mixers[bits.kind].learn(bits, self.stretched)

    def log_p(self, texts: Texts) -> np.ndarray:
        """ln P of every token before the adaptation."""
        out, owner, total = texts.extra.copy(), [], 0
        for bits in texts.steps():
            cost = self.mixers[bits.kind].cost(bits, self.stretched)
            if bits.first:
                out[owner] -= total  # no token twice
                owner, total = bits.owner, np.zeros(len(cost))
            if bits.kind == WORDS:
                total[: len(cost)] += cost
            else:
                np.subtract.at(out, bits.owner, cost.astype(np.float64))
        out[owner] -= total
        return out


def _prepared(shape: Shape, shared, learning: bool) -> Model:
    """The model with its stretched predictions; a worker keeps them for its next task beside the broadcast counts."""
    model = Model(shape, shared.value)
    kept = getattr(shared, "prepared", None)
    if kept and kept[0] == learning:
        model.stretched = kept[1]
    else:
        shared.prepared = None  # freed before the other one is made
        del kept
        model.prepare(learning)
        shared.prepared = learning, model.stretched
    return model


def _learn(shape: Shape, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _prepared(shape, shared, learning=True)
        for batch in chunks(batches, "codes", 2 << 20):
            model.learn(shape.texts(batch, learning=True))
        values = np.concatenate([m.packed() for m in model.mixers])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.float64())], ["at", "value"])

    return run


def _score(shape: Shape, shared, learned: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _prepared(shape, shared, learning=False)
        for mixer, values in zip(model.mixers, learned, strict=True):
            mixer.learned(values)
        names = ["doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base_score"]
        for batch in chunks(batches, "codes", CODES):
            texts = shape.texts(batch)
            out = adapted(model.log_p(texts), texts.ident, texts.lengths) / math.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(out)], [*names, "score"])

    return run


def train(coded: DataFrame, book: Book) -> tuple[Shape, object, list[np.ndarray]]:
    """Table sizes, the tables (broadcast) and the sums that the mixers take their weights from."""
    spark = coded.sparkSession
    learned_from = coded.where("NOT held_out").select("codes", "tails", "spelled")

    def count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], ["b", "n"])

    by_byte = np.zeros(256, np.int64)
    for r in learned_from.select("spelled").mapInArrow(count_bytes, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect():
        by_byte[r.b] = r.n
    shape = Shape(book, Code(by_byte))
    counted, tasks = learned_from.mapInArrow(_count_bits(shape), COUNT_TYPES), learned_from.rdd.getNumPartitions()
    while True:  # FAN tasks' slices at a time
        counted = counted.groupBy("chunk", F.floor(F.col("who") / FAN).alias("to")).applyInArrow(_merge, COUNT_TYPES)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    counts = np.zeros(-(-2 * shape.size // CHUNK) * CHUNK, np.float32)
    for r in written(counted, "mixing-tables").toLocalIterator():  # the tables' bounded size
        part = _slice(r.counts)
        counts[r.chunk * CHUNK : r.chunk * CHUNK + len(part)] += part
    shared = spark.sparkContext.broadcast(counts)
    sums = learned_from.mapInArrow(_learn(shape, shared), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    ends = np.cumsum([len(m.packed()) for m in Model(shape, counts).mixers])
    values = np.zeros(ends[-1])
    for r in sums:
        values[r.at] = r.value
    return shape, shared, np.split(values, ends[:-1])


def _seen_before(key: np.ndarray) -> np.ndarray:
    """How often each place's key came at earlier places."""
    n = len(key)
    low = np.uint64(n.bit_length())
    at = key >> low << low
    at |= np.arange(n, dtype=np.uint64)
    at.sort()  # by the keys' upper bits, then by place
    upper = at >> low
    at &= (np.uint64(1) << low) - np.uint64(1)
    order = at.view(np.int64)
    ranked = key[order]
    fresh = ranked[1:] != ranked[:-1]
    if (fresh != (upper[1:] != upper[:-1])).any():  # keys that only differ below
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = ranked[1:] != ranked[:-1]
    first = np.concatenate([[0], np.flatnonzero(fresh) + 1])
    before = np.empty(n, np.float64)
    before[order] = np.arange(n) - np.repeat(first, np.diff(first, append=n))
    return before


def _mixture(log_p: np.ndarray, before: np.ndarray, place: np.ndarray, strengths: tuple[float, ...], starts: np.ndarray, text: np.ndarray) -> np.ndarray:
    """ln P of each token where a cache of the text's past is mixed in at several strengths.

    Strength a says P(w) = (times w came before + a * P_model(w)) / (tokens before + a). The texts' probabilities
    under all strengths are averaged, which weights them at each token by how well they have done so far in the text.
    """
    again = np.flatnonzero(before > 0)
    totals = np.empty((len(strengths), len(log_p)))
    seen, p = before[again], np.exp(log_p[again])
    for i, a in enumerate(strengths):
        each = log_p + math.log(a)
        each[again] = np.log(seen + a * p)
        each -= np.log(place + a)
        sums = np.cumsum(each)
        np.subtract(sums, np.where(starts > 0, sums[starts - 1], 0)[text], out=totals[i])
    total = totals.max(0)
    totals -= total
    total += np.log(np.exp(totals, out=totals).sum(0)) - math.log(len(strengths))
    out = np.diff(total, prepend=0)
    out[starts] = total[starts]
    return out


def adapted(log_p: np.ndarray, ident: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """ln P of each text with adaptation to the text itself; tokens of the texts, by ``ident``, lie end to end.

    First the words of the text so far are mixed in, then the words that followed the same word in it. Some texts at a
    time, whose arrays stay in the processor's cache.
    """
    ends, out = np.cumsum(lengths), []
    for a, b in _cut(lengths, ADAPTED):
        tokens = slice(int(ends[a] - lengths[a]), int(ends[b - 1]))
        out.append(_adapted(log_p[tokens], ident[tokens], lengths[a:b]))
    return np.concatenate(out)


def _adapted(log_p: np.ndarray, ident: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    starts = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = (np.arange(len(ident)) - starts[text]).astype(np.float64)
    word = mix(ident + mix(np.arange(1, len(lengths) + 1, dtype=np.uint64))[text])
    before = _seen_before(word)
    one = _mixture(log_p, before, place, STRENGTHS, starts, text)
    last, after = np.zeros_like(word), np.zeros_like(before)
    last[1:], after[1:] = word[:-1], before[:-1]  # a word was followed as often before as it came before its last place
    last[starts], after[starts] = 0, 0
    two = _mixture(one, _seen_before(mix(last * ODD + word)), after, AFTER, starts, text)
    return np.add.reduceat(two, starts)


def code_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, Book]:
    """Steps 1 to 3: the coded texts, as a table, and what their codes depend on."""
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(fold, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    n_bytes = slim.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks = written(slim.mapInArrow(_blocks(max(1, -(-n_bytes // PART_BYTES))), BLOCK_TYPES), "mixing-blocks")
    of_part = blocks.where("part IS NOT NULL").select("block", "part", "words", "counts")
    placed = written(of_part.groupBy("part").applyInArrow(_count_part, PLACE_TYPES), "mixing-words")
    sums = [F.first(c).alias(c) for c in ("tokens", "known", "once", "twice", "mass")]
    book = Book(placed.groupBy("part").agg(*sums).collect())  # a row for each part
    texts = blocks.where("part IS NULL").select(F.col("block").alias("of_block"), "doc_id", "held_out", "numbers", "n_bytes")
    words = placed.select("block", "part", "totals", "places", "spelled", "tails")
    coded = words.groupBy("block").cogroup(texts.groupBy("of_block")).applyInArrow(_code_texts(book), CODED_TYPES)
    return written(coded, "mixing-coded"), book


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every document."""
    coded, book = code_texts(docs, text, doc_id)
    model = train(coded, book)
    schema = "doc_id bigint, held_out boolean, n_bytes bigint, n_tokens bigint, n_known bigint, base_score double, score double"
    out = coded.mapInArrow(_score(*model), schema)
    bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(book.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.session import table

    return score_texts(table(spark, sf_dir, "documents"))
