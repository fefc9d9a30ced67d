"""Benchmark passages in documents: latent semantic candidates, then longest common subsequences and answer checks."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm.common import ROWS, each, few, raw, table, texts
from cladeworks.session import settle

#: Words of half a window; windows of two halves overlap by one. Items of over LONG words are cut into equal parts of at most that length.
HALF, LONG = 16, 64
#: Dimensions of a block's latent space; power steps of the iteration.
DIMENSIONS, STEPS = 64, 2
#: Least cosine, in the space, of a window and an item's part to be looked at.
LEAST_COSINE = 0.8
#: Share of a part's words that a document must have in order; with the item's answer (its last words) as well, less will do.
LEAST_COMMON, LEAST_WITH_ANSWER, ANSWER_SHARE, ANSWER_MOST, LEAST_OF_ANSWER = 0.75, 0.5, 0.25, 8, 0.8
#: Of parts of SHORT words or more, a copy with each word edited at a chance of EDITED is to be caught in this share of all
#: cases, though it lacks more than a quarter; but never with less than LEAST_EDITED of the words.
SHORT, EDITED, CAUGHT, LEAST_EDITED = 12, 0.2, 0.95, 0.65
#: The benchmark is the stated query set. It is looked for in blocks of items of about so many words together, and of so
#: many parts; a task holds one block at a time. Texts that meet a block before the next one is loaded.
BLOCK_WORDS, BLOCK_PARTS, TEXTS = 200_000, 512, 4000


@functools.cache
def _plain() -> bytes:
    """A-Z to lower case, ASCII signs and control characters to blanks."""
    return bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256)).lower()


def words(text: bytes) -> list[bytes]:
    """The words of a text in lower case, of other letters than A-Z too, without ASCII signs."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode("utf-8", "replace")
    return text.translate(_plain()).split()


def seed_length(n: int, missing: int) -> int:
    """Words in a row that a copy of n words must have, if at most so many of them are missing or others."""
    return -(-(n - missing) // (missing + 1))


@functools.cache
def most_missing(n: int) -> int:
    """Words of a part's n that a copy may lack: a quarter, or the binomial bound of as many edits as chance brings."""
    most = int((1 - LEAST_COMMON) * n)
    if n < SHORT:
        return most
    edits, so_far = -1, 0.0
    while so_far < CAUGHT:
        edits += 1
        so_far += math.comb(n, edits) * EDITED**edits * (1 - EDITED) ** (n - edits)
    return max(most, min(edits, int((1 - LEAST_EDITED) * n)))


class Items:
    """A block of the benchmark's items as word numbers, with the vocabulary that they make."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids = [k for k, _ in rows]
        found = [words((t or "").encode("utf-8", "replace")) for _, t in rows]
        self.number: dict[bytes, int] = {}
        for ws in found:
            for w in ws:
                self.number.setdefault(w, len(self.number))
        self.parts: list[tuple[int, list[int]]] = []  # item and words
        self.answers: list[list[int]] = []  # of each part: the item's last words, if it is the last one
        for i, ws in enumerate(found):
            numbers = [self.number[w] for w in ws]
            n = max(1, min(ANSWER_MOST, round(ANSWER_SHARE * len(numbers))))
            cuts = [len(numbers) * k // max(1, -(-len(numbers) // LONG)) for k in range(-(-len(numbers) // LONG) + 1)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                self.parts.append((i, numbers[a:b]))
                self.answers.append(numbers[-n:] if b == len(numbers) else [])
        self.of = [i for i, _ in self.parts]
        self.seeds = self._seeds()

    def numbers(self, ws: list[bytes]):
        """Each word's number; the size of the vocabulary for words that no item has."""
        import numpy as np

        out_of = len(self.number)
        return np.fromiter((out_of if x is None else x for x in map(self.number.get, ws)), np.int64, len(ws))

    def grams(self, numbers, n: int):
        """Each place's n words (up to 3) in one number; -1 where one is not in the vocabulary."""
        import numpy as np

        size, base = max(0, len(numbers) - n + 1), len(self.number) + 1
        key, known = np.zeros(size, np.int64), np.ones(size, bool)
        for i in range(n):
            key = key * base + numbers[i : i + size]
            known &= numbers[i : i + size] != len(self.number)
        return np.where(known, key, -1)

    def _seeds(self):
        """For each length of seeds: the different grams in order, where each one's parts begin (and end), and the parts."""
        import numpy as np

        found: dict[int, set[tuple[int, int]]] = {}
        for p, (_, numbers) in enumerate(self.parts):
            answer = self.answers[p]
            whole = seed_length(len(numbers), int((1 - LEAST_COMMON) * len(numbers)))
            end = seed_length(len(answer), len(answer) - math.ceil(LEAST_OF_ANSWER * len(answer)))
            for own, n in ((numbers, whole), (answer, min(3, end))):
                if own:
                    found.setdefault(n, set()).update((key, p) for key in self.grams(np.array(own, np.int64), n).tolist())
        out = []
        for n, pairs in found.items():
            key, part = np.array(sorted(pairs), np.int64).T
            keys, start = np.unique(key, return_index=True)
            out.append((n, keys, np.append(start, len(key)), part))
        return out

    def seeded(self, numbers):
        """Place and part, for each place where some part's seed stands."""
        import numpy as np

        places, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, keys, start, part in self.seeds:
            grams = self.grams(numbers, n)
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            place = np.flatnonzero(keys[at] == grams)
            at = at[place]
            size = start[at + 1] - start[at]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            places.append(np.repeat(place, size))
            parts.append(part[np.repeat(start[at], size) + inner])
        return np.concatenate(places), np.concatenate(parts)


def _blocks(benchmark: DataFrame):
    """The items with an id, in blocks of about BLOCK_WORDS words or BLOCK_PARTS parts."""
    block, held, parts = [], 0, 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        n = len(words(r.text.encode("utf-8", "replace")))
        held, parts = held + n, parts - (-n // LONG)
        if held >= BLOCK_WORDS or parts >= BLOCK_PARTS:
            yield block
            block, held, parts = [], 0, 0
    if block:
        yield block


def _frequency(blocks: list):
    """Rows (block, word, n): how many documents that the task reads have each word; how many there are, at block -1."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        seen: dict[int, np.ndarray] = {}
        docs = 0
        one = len(blocks) == 1
        for b in few(batches, ROWS if one else TEXTS):
            found = map(words, raw(b.column("text")))
            found = found if one else [set(ws) for ws in found]
            docs += b.num_rows
            for k, items in enumerate(each(blocks)):
                get = items.number.get
                mine = seen.setdefault(k, np.zeros(len(items.number), np.int64))
                for ws in found:
                    mine[list(set(map(get, ws)) - {None})] += 1
        for k, mine in seen.items():
            at = np.flatnonzero(mine)
            yield pa.record_batch({"block": pa.array(np.full(len(at), k, np.int32)), "word": pa.array(at.astype(np.int32)), "n": pa.array(mine[at])})
        yield pa.record_batch({"block": pa.array([-1], pa.int32()), "word": pa.array([0], pa.int32()), "n": pa.array([docs], pa.int64())})

    return run


def document_frequency(docs: DataFrame, blocks: list) -> DataFrame:
    """block, word, n: in how many of all documents each word of each block's vocabulary is; and their number at block -1."""
    found = texts(docs).select("text").mapInArrow(_frequency(blocks), "block int, word int, n long")
    return settle(found.groupBy("block", "word").agg(F.sum("n").alias("n")), "frequency")


def _weights(part, idf):
    """A passage's normed TF-IDF vector, as words and weights."""
    import numpy as np

    w, n = np.unique(np.array(part, np.int64), return_counts=True)
    v = n * idf[w]
    return w, v / max(np.sqrt((v * v).sum()), 1e-12)


def latent_space(spark: SparkSession, items, idf):
    """An orthonormal basis (vocabulary x at most DIMENSIONS) of the space of the block's parts, by randomised subspace iteration.

    Tasks hold rows of the TF-IDF matrix A: all parts of the block, normed, weighted by how many of all documents have each
    word. Each step sums the tasks' shares of A'(A X) by word.
    """
    import numpy as np

    parts, n = items.value.parts, len(items.value.number)
    k = min(DIMENSIONS, len(parts), n)
    x = np.random.default_rng(42).standard_normal((n, k)) if k else np.zeros((n, 0))
    held = spark.sparkContext.broadcast(idf)
    rows = spark.range(0, len(parts), 1, max(1, min(64, len(parts) // 1024)))
    for _ in range(STEPS + 1) if k else ():
        basis = spark.sparkContext.broadcast(np.linalg.qr(x)[0])

        def share(batches, basis=basis):
            import numpy as np
            import pyarrow as pa

            it, idf, b = items.value, held.value, basis.value
            at, values, sums = [], [], np.zeros((len(it.number), b.shape[1]))
            for batch in batches:
                for i in batch.column("id").to_pylist():
                    w, v = _weights(it.parts[i][1], idf)
                    at.append(w)
                    values.append((v, v @ b[w]))
            for w, (v, y) in zip(at, values, strict=True):
                sums[w] += v[:, None] * y
            seen = np.unique(np.concatenate(at)) if at else np.zeros(0, np.int64)
            size = b.shape[1]
            yield pa.record_batch({"word": pa.array(seen.astype(np.int32)), "row": pa.ListArray.from_arrays(np.arange(0, size * len(seen) + 1, size, np.int32), sums[seen].ravel())})

        def summed(rows):
            import numpy as np
            import pyarrow as pa

            return pa.table({"word": rows["word"][:1], "row": pa.array([np.sum(rows["row"].to_pylist(), axis=0).tolist()], pa.list_(pa.float64()))})

        x = np.zeros((n, k))
        shares = rows.mapInArrow(share, "word int, row array<double>")
        for r in shares.groupBy("word").applyInArrow(summed, "word int, row array<double>").toLocalIterator():
            x[r.word] = r.row
    if k:
        left, values, _ = np.linalg.svd(x, full_matrices=False)
        x = left[:, : max(1, int((values > 1e-9 * values[0]).sum()))]
    return x


class Block:
    """A block's items, what each word adds to a window's place in the latent space, and the directions of the parts."""

    def __init__(self, items: Items, basis, idf):
        import numpy as np

        self.items, self.rows = items, (basis * idf[:, None]).astype(np.float32)
        places = np.stack([(lambda w, v: v @ basis[w])(*_weights(p, idf)) for _, p in items.parts], 1) if items.parts else np.zeros((basis.shape[1], 0))
        self.directions = (places / np.maximum(np.sqrt((places * places).sum(0)), 1e-12)).astype(np.float32)


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits: one step for each element of ``b``."""
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if m := at.get(w):
            row = (row + (row & m) | row & ~m) & full
    return len(a) - row.bit_count()


def compare(part: list[int], answer: list[int], found: list[int]) -> tuple[float, bool]:
    """The share of the part's words in ``found``, in order, and whether the item's answer, if the part has it, is there too."""
    return common_length(part, found) / len(part), bool(answer) and common_length(answer, found) >= LEAST_OF_ANSWER * len(answer)


def _matches(block: Block, ws: list[bytes]) -> dict:
    """The best share and cosine, and whether there is the answer, of each item that stands in a text of these words."""
    import numpy as np

    it, rows, directions = block.items, block.rows, block.directions
    best: dict[int, tuple] = {}
    if not ws or not it.parts:
        return best
    numbers, out_of = it.numbers(ws), len(it.number)
    for a in range(0, len(ws), 1 << 14):
        part = numbers[a : a + (1 << 14) + HALF]
        sums = np.zeros((-(-len(part) // HALF), rows.shape[1]), np.float32)
        known = np.flatnonzero(part != out_of)
        if not len(known):
            continue
        halves, start = np.unique(known // HALF, return_index=True)
        sums[halves] = np.add.reduceat(rows[part[known]], start, axis=0)
        if len(sums) > 1:
            sums = sums[:-1] + sums[1:]
        norms = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        products = sums @ directions
        near = products >= (LEAST_COSINE * np.maximum(norms, 1e-9))[:, None]
        place, seeded = it.seeded(part)
        near[np.minimum(place // HALF, len(near) - 1), seeded] = True
        spans: dict[tuple[int, int], tuple] = {}
        for k, p in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            i, own = it.parts[p]
            n, at = len(own), a + k * HALF
            if (at, n) not in spans:
                span = numbers[max(0, at - n) : at + 2 * HALF + n].tolist()
                spans[at, n] = span, set(span)
            span, there = spans[at, n]
            if sum(map(there.__contains__, own)) < LEAST_WITH_ANSWER * n:
                continue  # no order of these words can do
            share, answer = compare(own, it.answers[p], span)
            if share >= (n - most_missing(n)) / n or answer and share >= LEAST_WITH_ANSWER:
                old, cosine = best.get(i, (0.0, -1.0, False)), float(products[k, p] / max(norms[k], 1e-9))
                best[i] = (max(old[0], share), max(old[1], cosine), old[2] or answer)
    return best


def _search(blocks: list, keep_text: bool):
    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("common", pa.float64()), ("cosine", pa.float64()), ("answer", pa.bool_())]))
        for b in few(batches, ROWS if len(blocks) < 2 else TEXTS):
            found = [[] for _ in range(b.num_rows)]
            all_words = [words(t) for t in raw(b.column("text"))]
            for block in each(blocks):
                for mine, ws in zip(found, all_words, strict=True):
                    mine += [{"item_id": block.items.ids[i], "common": share, "cosine": cosine, "answer": answer} for i, (share, cosine, answer) in _matches(block, ws).items()]
            rest = {c: b.column(c) for c in b.schema.names if keep_text or c != "text"}
            yield pa.record_batch(rest | {"found": pa.array(found, kind)})

    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *more: str, keep_text: bool = False) -> DataFrame:
    """doc_id, the columns in ``more`` (and text, if it is to be kept), contaminated, and of the closest item item_id, common, cosine, answer; item_ids of all.

    A document is contaminated by an item if a stretch of it has enough of the words, in order, of the item or of one of
    the equal parts into which a long item is cut: three quarters, or what ``most_missing`` leaves (65 to 73 hundredths, as
    edits at a chance of 0.2 a word spread by the length); or half of them and the item's last words. Null texts and
    items are empty; items without a word match nothing; of items with one id each is looked for. Without items nothing
    is contaminated. Repeated rows get a result each; texts of any length are searched whole; an empty table gives
    none; columns that are not named are left behind.

    Candidates are windows near a part in a latent space fitted to all parts of a block of items; their words are weighted by
    frequencies in all documents, and nothing is sampled. What such a space can't hold has an exact way: windows with as many of a part's
    words in a row as any copy with up to a quarter of its words missing or replaced must have are compared as well, and
    those with as many of an item's last words in a row as its answer must have. Copies that lack more than a quarter have
    such runs or such a place nearly always, not by necessity.
    Items are looked for in blocks, of which a task holds one at a time, so texts are read twice and never
    written, however large the benchmark.
    """
    import numpy as np

    spark = docs.sparkSession
    rows = texts(docs, *more)
    kinds = dict(rows.dtypes)
    items = [spark.sparkContext.broadcast(Items(b)) for b in _blocks(benchmark)]
    blocks = []
    if items:
        seen = document_frequency(docs, items)
        total = seen.where("block = -1").first()
        total = total.n if total else 0
        for k, one in enumerate(each(items)):
            count = np.zeros(len(one.number))
            for r in seen.where(F.col("block") == k).toLocalIterator():  # at most a row for each word of the block
                count[r.word] = r.n
            idf = np.log((total + 1) / (count + 1)) + 0.05
            blocks.append(spark.sparkContext.broadcast(Block(one, latent_space(spark, items[k], idf), idf)))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns if keep_text or c != "text")
    rows = rows.mapInArrow(_search(blocks, keep_text), f"{schema}, found array<struct<item_id:bigint,common:double,cosine:double,answer:boolean>>")
    ranked = F.array_sort(F.transform("found", lambda x: F.struct((-x["common"]).alias("common"), (-x["cosine"]).alias("cosine"), x["item_id"].alias("item_id"), x["answer"].alias("answer"))))
    top = F.get(ranked, F.lit(0))
    best = [top["item_id"].alias("item_id"), (-top["common"]).alias("common"), (-top["cosine"]).alias("cosine"), top["answer"].alias("answer")]
    ids = F.array_sort(F.transform("found", lambda x: x["item_id"]))
    return rows.select(*(c for c in rows.columns if c != "found"), (F.size("found") > 0).alias("contaminated"), *best, ids.alias("item_ids"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which items of the benchmark; cases as in ``find_benchmark``."""
    return find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
