"""Benchmark passages in documents, by latent semantic retrieval and alignment.

1. A text becomes the numbers of those of its words (lower case, letters and digits only) that occur in the benchmark.
2. Passages are windows of ``WINDOW`` words every ``WINDOW // 2``. Features are the benchmark's words, weighted by inverse
   passage frequency over the whole corpus; words in more than ``COMMON`` of all passages have no weight, except the ``RAREST`` of each benchmark passage.
3. A randomised subspace iteration over all passages of the corpus and of the benchmark (weighted to equal the corpus's
   energy) gives the leading right singular vectors. The passages are read once for ``A^T A``, a triangle over the benchmark's
   vocabulary that tasks sum and write in stripes; a step multiplies the stripes, and the driver orthonormalises the product.
4. Every corpus passage with a weighted word is projected and compared by cosine with all benchmark passages, a stated
   query set, a block at a time; but for those in whose surroundings too few of any item's words stand for the decision in 5,
   which is counted exactly (``Pretest``).
5. For candidates from ``COSINE`` on, the longest common word subsequence of the item and the passage with its surroundings
   decides: at least ``COPY`` of the item is a leak; at least ``PARAPHRASE`` of it is one if ``RARE`` of its rare words (``COMMON``, and
   the ``RAREST`` of each item) are found in order too, and the answer, the item's last sentence, with ``ANSWER`` of its words.

The benchmark is a fixed test set; it is handled in blocks of ``BLOCK_ITEMS`` items, and each block's texts, the only thing
broadcast, are checked against ``BLOCK_BYTES``. Documents are never sampled.

Cases: null and empty texts hold no passage; benchmark items without words or without text match nothing; repeated benchmark
rows are one item, and several texts of one item_id are searched each, the best one is reported; repeated documents are reported once per doc_id and item; an empty table on either side gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from khata.lineage import cut
from khata.llm.base import small_batches
from khata.llm.shingles import slices, tokens

WINDOW = 48
STRIDE = WINDOW // 2
COMMON, RAREST = 0.02, 6
LATENT, OVERSAMPLE, PASSES = 192, 32, 2
#: Entries of ``A^T A`` that a task sums at once; a larger triangle takes several readings of the passages.
TRIANGLE = 8 << 20
COSINE, COPY, PARAPHRASE, RARE, ANSWER = 0.40, 0.70, 0.50, 0.60, 0.80
BLOCK_ITEMS, BLOCK_BYTES = 1000, 16 << 20
#: Bytes of word numbers, and of text, that a task takes at a time.
PIECE, TEXT_PIECE = 1 << 20, 2 << 20
BLANK_WORD = -1


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(bounds, word numbers, words) after dropping all but letters and digits from each word."""
    bounds, coded = tokens(texts)
    bare = pc.utf8_lower(pc.replace_substring_regex(coded.dictionary, r"[^\p{L}\p{N}]+", ""))
    return bounds, coded.indices.to_numpy(), bare.to_pylist()


@dataclass
class Pretest:
    """Words of which a region must hold some number of places before an item can be found in it; no latent figure enters.

    The decision needs ``COPY`` of the item's words in a region, or ``RARE`` of its rare ones. In the first case at most the rest is
    missing, so at least so many rare ones are there. Where that is less than two, ``PARAPHRASE`` of all its words are asked, which
    both cases need.
    """

    #: Of word w: items ``item[first[w]:first[w + 1]]``, and in how many places of each it stands.
    first: np.ndarray
    item: np.ndarray
    places: np.ndarray
    need: np.ndarray
    #: Words to both sides of a window that belong to its region, and words of a stretch of windows that are judged together.
    reach: int
    stretch: int

    @classmethod
    def of(cls, words: list[np.ndarray], rare: list[np.ndarray], size: int) -> Pretest:
        tests, need = [], []
        for whole, heavy in zip(words, rare, strict=True):
            copied = len(heavy) - len(whole) + math.ceil(COPY * len(whole) - 1e-9)
            least = min(math.ceil(RARE * len(heavy) - 1e-9), copied)
            tests.append(heavy if least >= 2 else whole)
            need.append(least if least >= 2 else math.ceil(PARAPHRASE * len(whole) - 1e-9))
        word = np.concatenate(tests)
        key, places = np.unique(word.astype(np.int64) * len(words) + np.repeat(np.arange(len(words)), [len(t) for t in tests]), return_counts=True)
        reach = max(len(w) for w in words)
        first = np.searchsorted(key // len(words), np.arange(size + 1))
        return cls(first, key % len(words), places, np.array(need), reach, STRIDE * max(10, -(-4 * reach // STRIDE)))

    def windows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(documents with a window to look at, whether each window of these is one)."""
        column = batch.column(batch.schema.names.index("numbers"))
        lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        numbers = np.frombuffer(b"".join(column.to_pylist()), np.int32)
        cells = -(-lengths // STRIDE) + 1
        stretches = -(-cells * STRIDE // self.stretch)
        base = np.concatenate([[0], np.cumsum(stretches)])
        asked = np.flatnonzero((numbers >= 0) & (np.diff(self.first, append=0)[numbers] > 0))
        doc = np.repeat(np.arange(len(lengths)), lengths)[asked]
        place = asked - (np.cumsum(lengths) - lengths)[doc]
        own = place // self.stretch
        key = [(base[doc] + own, numbers[asked])]
        after = (place >= (own + 1) * self.stretch - self.reach) & (own + 1 < stretches[doc])
        before = (place < own * self.stretch + STRIDE + self.reach) & (own > 0)
        key += [(base[doc[after]] + own[after] + 1, numbers[asked[after]]), (base[doc[before]] + own[before] - 1, numbers[asked[before]])]
        size = len(self.first) - 1
        there = np.unique(np.concatenate([a * size + b for a, b in key]))
        stretch, word = there // size, there % size
        passed = np.zeros(int(base[-1]), bool)
        items = len(self.need)
        for part in _chunks(stretch, 200_000):
            of, n = word[part], self.first[word[part] + 1] - self.first[word[part]]
            at = np.repeat(self.first[of], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            low = int(stretch[part][0])
            row = np.repeat(stretch[part] - low, n)
            held = np.bincount(row * items + self.item[at], self.places[at], (int(stretch[part][-1]) - low + 1) * items)
            passed[low:int(stretch[part][-1]) + 1] |= (held.reshape(-1, items) >= self.need).any(1)
        within = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
        window = passed[np.repeat(base[:-1], cells) + within * STRIDE // self.stretch]
        docs = np.flatnonzero(np.logical_or.reduceat(window, np.cumsum(cells) - cells)) if len(cells) else np.zeros(0, np.int64)
        return docs, window[np.repeat(np.isin(np.arange(len(cells)), docs), cells)]


@dataclass
class Benchmark:
    """Items of one block as word numbers, and what was learnt about the words."""

    items: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    number: dict[str, int]
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    basis: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    passage_item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    passages: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    #: Each item's rare words, in order.
    rare: list[np.ndarray] = field(default_factory=list)
    pretest: Pretest | None = None


def read_benchmark(rows: list) -> Benchmark:
    texts = sorted({(int(r["item_id"]), r["text"]) for r in rows})
    number: dict[str, int] = {}
    items, words, answers = [], [], []
    for item, text in texts:
        bounds, at, names = normal_words(pa.array([text]))
        own = [names[i] for i in at]
        numbers = np.array([number.setdefault(w, len(number)) for w in own if w], np.int32)
        if len(numbers) == 0:
            continue
        sentences = [s for s in text.replace("\n", ". ").split(". ") if s.strip(" .")]
        _, at, names = normal_words(pa.array([sentences[-1]]))
        items.append(item)
        words.append(numbers)
        answers.append(np.array([number[names[i]] for i in at if names[i] in number], np.int32))
    return Benchmark(items, words, answers, number)


def _numbers(bench: Benchmark):
    """Documents as 32-bit word numbers; words outside the benchmark are ``BLANK_WORD``, words without letters are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, size=TEXT_PIECE):
                bounds, at, names = normal_words(piece.column("text"))
                own = np.array([bench.number.get(w, BLANK_WORD) if w else -2 for w in names], np.int32)
                numbers = own[at] if len(own) else np.zeros(0, np.int32)
                real = numbers != -2
                ends = np.concatenate([[0], np.cumsum(real)])[bounds]
                numbers = numbers[real]
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id").cast(pa.int64()),
                    pa.array([numbers[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                ], ["doc_id", "numbers"])
    return run


def cells_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, cell of each word, first cell of each document); a cell is ``STRIDE`` words, each document ends with an empty one."""
    column = batch.column(batch.schema.names.index("numbers"))
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    numbers = np.frombuffer(b"".join(column.to_pylist()), np.int32)
    per = -(-lengths // STRIDE) + 1
    first = np.concatenate([[0], np.cumsum(per)])
    within = np.arange(len(numbers)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return numbers, np.repeat(first[:-1], lengths) + within // STRIDE, first


def window_words(batch: pa.RecordBatch, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(window, word) pairs with weight, each once and sorted, the number of windows, and the first window of each document.

    Window c is the cells c and c + 1.
    """
    numbers, cell, first = cells_of(batch)
    use = (numbers >= 0) & (weight[numbers] > 0)
    numbers, cell = numbers[use].astype(np.int64), cell[use]
    starts = np.isin(cell, first)
    key = np.concatenate([cell * len(weight) + numbers, ((cell - 1) * len(weight) + numbers)[~starts]])
    key = np.unique(key)
    return key // len(weight), key % len(weight), int(first[-1]), first


def _place(cell: np.ndarray) -> np.ndarray:
    """The place of each word in its cell."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    return np.arange(len(cell)) - np.repeat(starts, np.diff(np.append(starts, len(cell))))


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, windows = np.zeros(size, np.int64), 0
        for piece in (p for batch in batches for p in slices(batch, "numbers", PIECE)):
            numbers, cell, first = cells_of(piece)
            # the words of a cell in one row, sorted: each counts where it differs from the one before
            rows = np.full((int(first[-1]), STRIDE), BLANK_WORD, np.int32)
            rows[cell, _place(cell)] = numbers
            rows.sort(axis=1)
            fresh = rows >= 0
            fresh[:, 1:] &= rows[:, 1:] != rows[:, :-1]
            total += np.bincount(rows[fresh], minlength=size)
            windows += int(first[-1]) - piece.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(total[used], windows), pa.int64())], ["word", "n"])
    return run


def _unit(window: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Values of sorted windows' entries, each window's scaled to length 1."""
    if len(window) == 0:
        return value
    starts = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
    return value / np.repeat(np.sqrt(np.add.reduceat(value ** 2, starts)), np.diff(np.append(starts, len(window))))


def _rows(window: np.ndarray, word: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows present, their unit rows times ``basis``, entry values) for sorted (window, word) pairs."""
    starts = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
    norm = np.sqrt(np.add.reduceat(weight[word] ** 2, starts))
    value = weight[word] / np.repeat(norm, np.diff(np.append(starts, len(window))))
    return window[starts], np.add.reduceat(basis[word] * value[:, None], starts, axis=0), value


def _accumulate(out: np.ndarray, window: np.ndarray, word: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> None:
    """Add ``A^T (A basis)`` of the given rows to ``out``."""
    if len(window) == 0:
        return
    present, projected, value = _rows(window, word, weight, basis)
    row = np.searchsorted(present, window)
    order = np.argsort(word, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], word[order][1:] != word[order][:-1]]))
    out[word[order][starts]] += np.add.reduceat(projected[row[order]] * value[order][:, None], starts, axis=0)


def _chunks(window: np.ndarray, size: int = 4_000) -> Iterator[slice]:
    """Slices of sorted pairs that end between windows."""
    at = 0
    while at < len(window):
        to = min(len(window), at + size)
        if to < len(window):
            to = int(np.searchsorted(window, window[to], side="left"))
            to = to if to > at else int(np.searchsorted(window, window[at], side="right"))
        yield slice(at, to)
        at = to


STRIPE = 64


def _pairs(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, place) of all two entries of each window, the first not behind the second, each entry with itself included."""
    starts = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
    size = np.diff(np.append(starts, len(window)))
    at = np.arange(len(window))
    reach = np.repeat(starts + size, size) - at
    left = np.repeat(at, reach)
    return left, np.arange(len(left)) + np.repeat(at - np.cumsum(reach) + reach, reach)


def _rows_at_once(size: int) -> list[tuple[int, int]]:
    """Ranges of rows of the lower triangle with at most ``TRIANGLE`` entries, in whole stripes."""
    out, low, held = [], 0, 0
    for at in range(0, size, STRIPE):
        own = sum(i + 1 for i in range(at, min(at + STRIPE, size)))
        if held and held + own > TRIANGLE:
            out.append((low, at))
            low, held = at, 0
        held += own
    return [*out, (low, size)]


def _gram(weight: np.ndarray, rank: np.ndarray, low: int, high: int):
    """The rows from ``low`` to ``high`` of the lower triangle of ``A^T A`` over a task's passages.

    Words stand at their ``rank``, frequent ones first: most pairs then fall into a small corner of the triangle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(weight)
        first = np.arange(size + 1) * np.arange(1, size + 2) // 2
        out = np.zeros(int(first[high] - first[low]), np.float32)
        heavy = np.zeros(size, np.float32)
        heavy[rank] = weight
        for batch in batches:
            for piece in slices(batch, "numbers", PIECE):
                window, word, _, _ = window_words(piece, weight)
                key = np.sort(window * size + rank[word])
                window, word = key // size, key % size
                value = _unit(window, heavy[word])
                for part in _chunks(window):
                    left, right = _pairs(window[part])
                    if (low, high) != (0, size):
                        own = (word[part][right] >= low) & (word[part][right] < high)
                        left, right = left[own], right[own]
                    np.add.at(out, (first[word[part]] - first[low])[right] + word[part][left], value[part][left] * value[part][right])
        for s in range(low, high, STRIPE):
            own = out[first[s] - first[low]:first[min(s + STRIPE, high)] - first[low]]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([s // STRIPE], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["stripe", "part"])
    return run


def _times(basis: np.ndarray):
    """``A^T A`` times ``basis``, from stripes of the triangle: each stands for its rows and, mirrored, for its columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(basis)
        out = np.zeros(basis.shape, np.float64)
        for batch in batches:
            for stripe, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, values, used = stripe * STRIPE, np.frombuffer(part.as_buffer(), np.float64), 0
                to = min(at + STRIPE, size)
                rows = np.zeros((to - at, to))
                for i in range(at, to):
                    rows[i - at, :i + 1] = values[used:used + i + 1]
                    used += i + 1
                out[at:to] += rows @ basis[:to]
                rows[np.arange(to - at), np.arange(at, to)] = 0
                out[:to] += rows.T @ basis[at:to]
        for s in range(0, size, STRIPE):
            yield pa.RecordBatch.from_arrays([pa.array([s // STRIPE], pa.int64()), pa.array([out[s:s + STRIPE].astype(np.float32).tobytes()], pa.binary())], ["stripe", "part"])
    return run


def _add_stripes(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in group["part"])
    return pa.table({"stripe": group["stripe"].slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})


def _bench_rows(bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, word) pairs of the benchmark's passages and the item of each window."""
    batch = pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in bench.words], pa.binary())], ["numbers"])
    window, word, _, first = window_words(batch, bench.weight)
    return window, word, np.searchsorted(first, np.unique(window), side="right") - 1


def learn(numbers: DataFrame, bench: Benchmark, seed: int = 7) -> Benchmark:
    """Word weights and latent basis from all passages; the collected matrices have one row per benchmark word."""
    size = len(bench.number)
    counts = {r["word"]: r["n"] for r in numbers.mapInArrow(_frequencies(size), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    passages = max(1, counts.pop(-1, 0))
    seen = np.zeros(size)
    for word, n in counts.items():
        seen[word] = n
    weight = np.log((passages + 1) / (seen + 1)).astype(np.float32)
    keep = seen <= COMMON * passages
    for own in bench.words:
        keep[own[np.argsort(seen[own], kind="stable")[:RAREST]]] = True
    bench.rare = [own[keep[own]] for own in bench.words]
    for own in bench.words:
        for at in range(0, len(own), STRIDE):
            words = np.unique(own[at:at + WINDOW])
            keep[words[np.argsort(seen[words], kind="stable")[:RAREST]]] = True
    bench.weight = np.where(keep, np.maximum(weight, 1e-3), 0).astype(np.float32)

    bench.pretest = Pretest.of(bench.words, bench.rare, size)
    parts = "stripe long, part binary"
    # a triangle per task is sent, so there are no more tasks than run at a time
    few = numbers.coalesce(numbers.sparkSession.sparkContext.defaultParallelism)
    often = np.argsort(-seen, kind="stable")
    rank = np.argsort(often)
    gram = None
    for low, high in _rows_at_once(size):
        own = cut(few.mapInArrow(_gram(bench.weight, rank, low, high), parts).groupBy("stripe").applyInArrow(_add_stripes, parts), "bench-gram")
        gram = own if gram is None else gram.unionByName(own)
    window, word, _ = _bench_rows(bench)
    width = min(LATENT + OVERSAMPLE, size)
    basis = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)
    for _ in range(PASSES):
        done = gram.mapInArrow(_times(basis[often]), parts).groupBy("stripe").applyInArrow(_add_stripes, parts).collect()
        corpus = np.concatenate([np.frombuffer(r["part"], np.float64).reshape(-1, width) for r in sorted(done, key=lambda r: r["stripe"])])[rank] if done else np.zeros((size, width))
        own = np.zeros((size, width), np.float32)
        _accumulate(own, window, word, bench.weight, basis)
        ratio = np.linalg.norm(corpus) / max(np.linalg.norm(own), 1e-9)
        left, _, _ = np.linalg.svd(corpus + max(ratio, 1.0) * own, full_matrices=False)
        basis = np.ascontiguousarray(left, np.float32)
    bench.basis = np.ascontiguousarray(basis[:, :LATENT])
    present, projected, _ = _rows(window, word, bench.weight, bench.basis)
    bench.passages = (projected / np.maximum(np.linalg.norm(projected, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    bench.passage_item = _bench_rows(bench)[2]
    return bench


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit vectors over ``b``."""
    places: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for w in a.tolist():
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _search(shared, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = shared.value
        there = np.zeros(len(bench.number), bool)
        for batch in (p for batch in batches for p in slices(batch, "numbers", PIECE)):
            docs, asked = bench.pretest.windows(batch)
            if len(docs) == 0:
                continue
            batch = batch.take(pa.array(docs))
            window, word, _, first = window_words(batch, bench.weight)
            window, word = window[asked[window]], word[asked[window]]
            found: dict[tuple[int, int], tuple[float, set[int]]] = {}
            for part in _chunks(window):
                present, projected, _ = _rows(window[part], word[part], bench.weight, bench.basis)
                norm = np.linalg.norm(projected, axis=1, keepdims=True)
                near = (projected / np.maximum(norm, 1e-6)) @ bench.passages.T
                for row, passage in zip(*np.nonzero(near >= cosine), strict=True):
                    key = (int(np.searchsorted(first, present[row], side="right")) - 1, int(bench.passage_item[passage]))
                    best, where = found.get(key, (0.0, set()))
                    where.add(int(present[row] - first[key[0]]))
                    found[key] = (max(best, float(near[row, passage])), where)
            rows = []
            for (doc, item), (best, where) in found.items():
                text = np.frombuffer(batch.column(batch.schema.names.index("numbers"))[doc].as_py(), np.int32)
                wanted, answer = bench.words[item], bench.answers[item]
                most, rare, answered = 0, 0, False
                heavy = bench.rare[item]
                for c in sorted(where):
                    region = text[max(0, c * STRIDE - len(wanted)):c * STRIDE + WINDOW + len(wanted)]
                    # a subsequence is no longer than the words that are there at all
                    known = region[region >= 0]
                    there[known] = True
                    whole, part = np.count_nonzero(there[wanted]), np.count_nonzero(there[heavy])
                    there[known] = False
                    if whole < COPY * len(wanted) and (whole < PARAPHRASE * len(wanted) or part < RARE * len(heavy)):
                        continue
                    most = max(most, common_subsequence(region, wanted))
                    rare = max(rare, common_subsequence(region, heavy))
                    answered = answered or len(answer) == 0 or common_subsequence(region, answer) >= ANSWER * len(answer)
                if most >= COPY * len(wanted) or (most >= PARAPHRASE * len(wanted) and rare >= RARE * len(heavy) and answered):
                    rows.append((batch.column(batch.schema.names.index("doc_id"))[doc].as_py(), bench.items[item], best, most, len(wanted), answered))
            yield pa.RecordBatch.from_pylist([dict(zip(HITS.names, r, strict=True)) for r in rows], schema=HITS)
    return run


HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.int64()), ("item_words", pa.int64()), ("answered", pa.bool_())])


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id) of every benchmark item found in a document, with its best cosine, common words and whether the answer is there."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    blocks = items.count() // BLOCK_ITEMS + 1
    items = cut(items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "bench-items")
    out = None
    for block in sorted(r["block"] for r in items.select("block").distinct().collect()):
        own = items.filter(F.col("block") == block)
        if (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BLOCK_BYTES:
            raise ValueError(f"more than {BLOCK_BYTES} bytes in {BLOCK_ITEMS} benchmark items: give smaller blocks")
        bench = read_benchmark(own.collect())
        if not bench.items:
            continue
        numbers = cut(docs.select("doc_id", "text").mapInArrow(_numbers(bench), "doc_id long, numbers binary"), "bench-numbers")
        shared = spark.sparkContext.broadcast(learn(numbers, bench))
        hits = numbers.mapInArrow(_search(shared, cosine), "doc_id long, item_id long, cosine double, lcs long, item_words long, answered boolean")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs long, item_words long, answered boolean")
    best = F.max(F.struct(F.col("lcs") / F.col("item_words"), "lcs", "item_words"))
    found = out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), best.alias("best"), F.bool_or("answered").alias("answered"))
    return found.select("doc_id", "item_id", "cosine", "best.lcs", "best.item_words", "answered")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all columns. Rows of one doc_id, null included, are one document."""
    bad = cut(leaks(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct(), "bench-bad")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")
