"""Language-model scores by deleted interpolation of n-grams.

The probability of a token is a mixture of maximum-likelihood estimates: level k holds c(k-gram) / c(its first k-1 tokens), and
p_k = w_k(b) * ratio + (1 - w_k(b)) * p_(k-1), down to p_0 = 1 / (V + 1), V the number of different training tokens and one place for all
others. The weight depends on how frequent the context is (b: the bit length of its count; an unseen context has weight 0). Weights
are learned by expectation-maximisation: one part of the training documents is deleted from the counts, its tokens are predicted
from what is left, and the weights are moved until its likelihood settles. Scores are then made with the counts of all training documents.

How it works: documents are written as block files of BLOCK_BYTES of text. A block asks for the counts of its distinct n-grams, each once,
as sorted 64-bit names with how often it has them itself; the asks meet by ranges of the names, where they are summed up, and the sums go back in
the order of the ask. A block asks for a name at most once, so no n-gram, however common, makes a group of more rows than there
are blocks, and ranges are even because names are hashes. Each block then scores its documents. Counts of all n-grams of all
training documents are kept; nothing is pruned, and what is gathered grows with the corpus. The expectation step is a sum over
the deleted tokens by weight bucket, a few hundred numbers for the driver.

Tokens: words split at [\\x20\\x09-\\x0D] with A-Z in lower case, then one end. A text begins in a context of its own. Two n-grams
of the same name would be counted together; with T different ones the odds of any such pair are about T^2 / 2^65.

Edge cases: a null or empty text is one end token; a null id is a training document that is not deleted; rows with one id score by their
own texts; texts longer than a block go on in the next, with the context carried over; without training documents (or an empty
table) every token has 1 / (V + 1) = 1; without deleted tokens in a bucket the weight of the nearest bucket holds, at first START. Other
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, Numbers, new_dir, pieces_at_blanks, stage, utf8
from .planes import pack, unpack
from .token_ids import filesystem

ORDER = 2
BLOCK_BYTES = 4 << 20
#: Names that come together in a range.
RANGE_NAMES = 1 << 20
#: A training document in so many is deleted from the counts that the weights are learned on.
DELETED = 8
START = 0.5
MOST = 1 - 1e-6
ROUNDS = 40
SETTLED = 1e-6

_END, _BEGIN = np.uint64(xxhash.xxh64_intdigest(b"\n", 1)), np.uint64(xxhash.xxh64_intdigest(b"\n", 2))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_FILE = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("whole", pa.bool_()), ("last", pa.bool_()), ("lead", pa.int64()), ("part", pa.int64()), ("text", pa.binary())])
#: What a document is for: its counts, its counts and the weights, or neither.
TRAIN, DELETE, HELD_OUT = 0, 1, 2


def document_part(id_col: str, folds: int = 7, held_out: int = 2):
    """TRAIN, DELETE or HELD_OUT by the crc32 of the id as text."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    deleted = F.crc32(F.concat(F.lit("deleted"), F.col(id_col).cast("string")).cast("binary")) % DELETED == 0
    return F.when(crc % folds == held_out, HELD_OUT).when(deleted, DELETE).otherwise(TRAIN).cast("long")


def write_blocks(docs: DataFrame, order: int, block_bytes: int) -> DataFrame:
    """Writes (id, part, bytes) as block files in the shared folder. The manifest: (block, path, n, trained, deleted): n-grams at most, and documents."""
    folder = new_dir(docs.sparkSession, "interpolation-blocks")
    schema = pa.schema([(c, pa.string() if c == "path" else pa.int64()) for c in ("block", "path", "n", "trained", "deleted")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 33
        number = row = task
        rows, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            path = f"{folder}/{number}-{uuid.uuid4().hex}.arrow"
            where, name = filesystem(path)
            where.create_dir(name.rpartition("/")[0], recursive=True)
            with where.open_output_stream(name) as out, pa.ipc.new_file(out, _FILE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                for at in range(0, len(rows), 1000):
                    file.write_batch(pa.RecordBatch.from_pylist(rows[at : at + 1000], _FILE))
            ends = [x["part"] for x in rows if x["last"]]
            n = order * sum(x["text"].count(b" ") + 2 for x in rows)
            yield pa.RecordBatch.from_pylist([{"block": number, "path": path, "n": n, "trained": sum(p != HELD_OUT for p in ends), "deleted": ends.count(DELETE)}], schema)

        for batch in batches:
            for doc_id, part, text in zip(*map(pa.Array.to_pylist, batch.columns[:2]), batch.column(2), strict=True):
                pieces, held, lead, whole = pieces_at_blanks(text.as_py(), min(block_bytes, PIECE_BYTES)), [], 0, True
                piece = next(pieces)
                while piece is not None:
                    held.append(b" ".join(piece.lower().split()))
                    size += len(held[-1]) + 1
                    piece = next(pieces, None)
                    if size >= block_bytes or piece is None:
                        whole &= piece is None
                        text = b" ".join(x for x in held if x)
                        rows.append({"row": row, "id": doc_id, "whole": whole, "last": piece is None, "lead": lead, "part": part, "text": text})
                        # the next part begins with the words that its first tokens follow
                        held = [b" ".join(text.rsplit(b" ", order - 1)[-order + 1 :])] if order > 1 and text else []
                        lead = len(held[0].split()) if held else 0
                        if size >= block_bytes:
                            yield from send()
                            rows, size, number = [], 0, number + 1
                row += 1
        if rows:
            yield from send()

    return stage(docs.mapInArrow(run, "block long, path string, n long, trained long, deleted long"), "interpolation-manifest")


class Block:
    """The tokens of a block file: their n-grams' names by level, and where each document's tokens are."""

    def __init__(self, path: str, order: int):
        where, name = filesystem(path)
        with where.open_input_file(name) as data:
            file = pa.ipc.open_file(data)
            batches = (file.get_batch(k) for k in range(file.num_record_batches))
            index, parts, told = Numbers(), [], []
            for batch in batches:
                told.append(batch.drop_columns(["text"]))
                for text, ends in zip(batch["text"], batch["last"].to_pylist(), strict=True):
                    ids = np.fromiter(map(index.__getitem__, text.as_py().split()), np.int32)
                    parts.append(np.append(ids, np.int32(-1)) if ends else ids)
        self.docs = pa.Table.from_batches(told)
        names = np.append(np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index)), _END)
        del index
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        tokens = names[np.concatenate(parts)]
        del parts
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        begin = np.cumsum(self.sizes) - self.sizes
        self.place = (np.arange(len(tokens)) - begin[self.doc]).astype(np.int32)
        #: Words of the part before are context only.
        self.own = self.place >= np.array(self.docs["lead"], np.int32)[self.doc]
        self.part = np.array(self.docs["part"], np.int8)[self.doc]
        self.names, context, start = [tokens], tokens, _BEGIN
        with np.errstate(over="ignore"):
            for _ in range(1, order):
                before = np.empty_like(context)
                before[1:] = context[:-1]
                before[self.place == 0] = start
                context = (before ^ (before >> np.uint64(29))) * _MIX + tokens
                context ^= context >> np.uint64(32)
                self.names.append(context)
                start = (start ^ (start >> np.uint64(29))) * _MIX + _BEGIN
                start ^= start >> np.uint64(32)

    def asks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By level: the distinct names in order, and how often training and deleted documents of this block have them."""
        for names in self.names:
            different, at = np.unique(names, return_inverse=True)
            yield different, *[np.bincount(at[self.own & which], minlength=len(different)) for which in (self.part != HELD_OUT, self.part == DELETE)]

    def counts(self, answers: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By level: how often all training and all deleted documents have each token's n-gram."""
        out = []
        for level, names in enumerate(self.names):
            mine = sorted((x for x in answers if x["level"] == level), key=lambda x: x["range"])
            at = np.unique(names, return_inverse=True)[1].astype(np.int32)
            out.append(tuple(np.concatenate([unpack(x.pop(c), "<u8").view(np.int64) for x in mine])[at] if mine else np.zeros(0, np.int64) for c in ("counted", "deleted")))
        return out

    def contexts(self, counts: list[np.ndarray], tokens: int, documents: int) -> list[np.ndarray]:
        """By level: how often each token's context occurs; a text's beginning as often as there are documents."""
        out = [np.full(len(self.doc), tokens)]
        for shorter in counts[:-1]:
            before = np.empty_like(shorter)
            before[1:] = shorter[:-1]
            before[self.place == 0] = documents
            out.append(before)
        return out


def bucket_of(context: np.ndarray) -> np.ndarray:
    """The bit length of a count."""
    return np.frexp(context.astype(np.float64))[1].astype(np.int32)


@dataclass
class Totals:
    tokens: int
    types: int
    documents: int
    deleted_tokens: int
    deleted: int


def ask_and_answer(manifest: DataFrame, order: int, range_names: int) -> DataFrame:
    """(block, level, range, counted, deleted, types, tokens, deleted_tokens): the sums of what blocks have, in the order of each block's names."""
    n = manifest.agg(F.sum("n")).first()[0] or 0
    bits = max(int(n // range_names).bit_length(), 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("range", pa.int32()), *[(c, pa.binary()) for c in ("names", "counted", "deleted")]])
        for batch in batches:
            for x in batch.to_pylist():
                for level, (names, counted, deleted) in enumerate(Block(x["path"], order).asks()):
                    cuts = np.searchsorted(names >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
                    for r in np.flatnonzero(np.diff(cuts)).tolist():
                        some = slice(cuts[r], cuts[r + 1])
                        row = [x["block"], level, r, pack(np.diff(names[some], prepend=np.uint64(0)), "<u8"), pack(counted[some]), pack(deleted[some])]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        names = [np.cumsum(unpack(x.pop("names"), "<u8"), dtype=np.uint64) for x in rows]
        different, at = np.unique(np.concatenate(names), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([unpack(x[c]) for x in rows]), len(different)).astype(np.uint64) for c in ("counted", "deleted")]
        out, begin = [], 0
        for k, x in enumerate(rows):
            mine = at[begin : begin + len(names[k])]
            begin += len(mine)
            told = [int((sums[0] > 0).sum()), int(sums[0].sum()), int(sums[1].sum())] if k == 0 else [0, 0, 0]
            out.append([x["block"], x["level"], x["range"], *[pack(s[mine], "<u8") for s in sums], *told])
        schema = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("range", pa.int32()), ("counted", pa.binary()), ("deleted", pa.binary())] + [(c, pa.int64()) for c in ("types", "tokens", "deleted_tokens")])
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    work = manifest.repartition(min(max(manifest.count(), 1), 10_000))
    asks = work.mapInArrow(ask, "block long, level int, range int, names binary, counted binary, deleted binary")
    answers = asks.groupBy("level", "range").applyInArrow(answer, "block long, level int, range int, counted binary, deleted binary, types long, tokens long, deleted_tokens long")
    return stage(answers, "interpolation-answers")


def totals_of(manifest: DataFrame, answers: DataFrame) -> Totals:
    t = answers.where("level = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "deleted_tokens")]).first()
    d = manifest.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("trained", "deleted")]).first()
    return Totals(t[0], t[1], d[0], t[2], d[1])


def _by_block(manifest: DataFrame, answers: DataFrame):
    told = answers.select("block", "level", "range", "counted", "deleted")
    return manifest.select("block", "path").groupBy("block").cogroup(told.groupBy("block"))


def deleted_tokens(manifest: DataFrame, answers: DataFrame, order: int, totals: Totals) -> DataFrame:
    """(r1, b1, r2, b2, ..., n): the deleted documents' tokens by the ratios and context buckets that the other training documents give."""
    columns = [f"{x}{k + 1}" for k in range(order) for x in "rb"]
    kinds = [pa.float64(), pa.int32()] * order + [pa.int64()]

    def run(key: tuple, files: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(files["path"][0].as_py(), order)
        counts = block.counts(answers.to_pylist())
        left = [c - d for c, d in counts]
        context = block.contexts(left, totals.tokens - totals.deleted_tokens, totals.documents - totals.deleted)
        which = np.flatnonzero(block.own & (block.part == DELETE))
        found = []
        for c, n in zip(left, context, strict=True):
            found += [c[which] / np.maximum(n[which], 1), bucket_of(n[which])]
        sort = np.lexsort(found)
        new = np.zeros(len(which), bool)
        new[:1] = True
        for x in found:
            new[1:] |= x[sort][1:] != x[sort][:-1]
        at = np.flatnonzero(new)
        values = [x[sort][at] for x in found] + [np.diff(np.append(at, len(which)))]
        return pa.table({c: pa.array(v, t) for c, v, t in zip([*columns, "n"], values, kinds, strict=True)})

    schema = ", ".join(f"{c} {'double' if c[0] == 'r' else 'int'}" for c in columns) + ", n long"
    return stage(_by_block(manifest, answers).applyInArrow(run, schema), "interpolation-deleted")


def learn_weights(tokens: DataFrame, order: int, types: int, rounds: int = ROUNDS) -> tuple[list[list[float]], list[float]]:
    """Weights by level and bucket, and the mean log likelihood of the deleted tokens after each round."""
    weights = [[0.0] + [START] * 64 for _ in range(order)]
    seen: list[set[int]] = [set() for _ in range(order)]
    likelihood: list[float] = []
    for _ in range(rounds):
        p, step = f"{1 / (types + 1)!r}D", tokens
        for k in range(1, order + 1):
            step = step.withColumn(f"w{k}", F.get(F.array(*map(F.lit, weights[k - 1])), F.col(f"b{k}")))
            step = step.withColumn(f"p{k}", F.expr(f"w{k} * r{k} + (1 - w{k}) * {p}"))
            p = f"p{k}"
        share, sums = f"n / {p}", [F.sum(F.expr(f"n * ln({p})")).alias("likelihood"), F.sum("n").alias("n")]
        for k in range(order, 0, -1):  # of a token, what level k or lower explains, and what level k itself does
            sums += [F.sum(F.expr(f"{share} * p{k}")).alias(f"below{k}"), F.sum(F.expr(f"{share} * w{k} * r{k}")).alias(f"own{k}")]
            share = f"{share} * (1 - w{k})"
        rows = step.groupBy(*[f"b{k}" for k in range(1, order + 1)]).agg(*sums).collect()
        if not rows:
            break
        likelihood.append(sum(r["likelihood"] for r in rows) / sum(r["n"] for r in rows))
        for k in range(1, order + 1):
            for b in {r[f"b{k}"] for r in rows} - {0}:
                own, below = (sum(r[f"{c}{k}"] for r in rows if r[f"b{k}"] == b) for c in ("own", "below"))
                seen[k - 1].add(b)
                weights[k - 1][b] = min(own / below, MOST) if below > 0 else weights[k - 1][b]
        if len(likelihood) > 1 and likelihood[-1] - likelihood[-2] < SETTLED:
            break
    for level, some in zip(weights, seen, strict=True):
        for b in range(1, len(level)):
            if some and b not in some:
                level[b] = level[min(some, key=lambda x: (abs(x - b), x))]
    return weights, likelihood


def score_blocks(manifest: DataFrame, answers: DataFrame, order: int, totals: Totals, weights: list[list[float]]) -> DataFrame:
    """(id, held_out, n_tokens, n_known, base_score, score) of every row."""
    tables = [np.array(w) for w in weights]

    def run(key: tuple, files: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(files["path"][0].as_py(), order)
        counts = [c for c, _ in block.counts(answers.to_pylist())]
        p = 1 / (totals.types + 1)
        for c, n, table in zip(counts, block.contexts(counts, totals.tokens, totals.documents), tables, strict=True):
            w = table[bucket_of(n)]
            p = w * c / np.maximum(n, 1) + (1 - w) * p
        own = block.own
        base = np.log10((counts[0] + 1) / (totals.tokens + totals.types + 1))
        sums = [np.bincount(block.doc[own], x if x is None else x[own], len(block.sizes)) for x in (None, counts[0] > 0, base, np.log10(p))]
        columns = [block.docs["row"], block.docs["whole"], block.docs["id"], np.array(block.docs["part"]) == HELD_OUT]
        columns += [pa.array(s.astype(t)) for s, t in zip(sums, (np.int64, np.int64, np.float64, np.float64), strict=True)]
        return pa.table(dict(zip(("row", "whole", "id", "held_out", "n_tokens", "n_known", "base_score", "score"), columns, strict=True)))

    schema = "row long, whole boolean, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    found = stage(_by_block(manifest, answers).applyInArrow(run, schema), "interpolation-scores")
    columns = ["n_tokens", "n_known", "base_score", "score"]
    spread = found.where("not whole").groupBy("row").agg(F.max("id").alias("id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in columns])
    return found.where("whole").select("id", "held_out", *columns).unionByName(spread.drop("row"))


def text_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES, range_names: int = RANGE_NAMES
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): base_score by single tokens with one added to each count, score by the model."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), document_part(id_col).alias("part"), utf8(F.col(text_col)).alias("bytes"))
    manifest = write_blocks(rows, order, block_bytes)
    answers = ask_and_answer(manifest, order, range_names)
    totals = totals_of(manifest, answers)
    weights, _ = learn_weights(deleted_tokens(manifest, answers, order, totals), order, totals.types)
    return score_blocks(manifest, answers, order, totals, weights).withColumn("train_tokens", F.lit(totals.tokens).cast("long"))
