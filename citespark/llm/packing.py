"""Packing of token sequences: vector bin packing by the dot-product heuristic.

A bin is a sequence with room in three dimensions: tokens, segments (pieces) and loss-bearing tokens. Of the pieces at
hand that fit whole, the one whose demand has the largest dot product with the room left is placed; if none fits, one is
cut where a dimension is full. What then stays short of ``max_tokens`` is cut at a power of two, the other length that
needs no padding, and the cut-off part goes back to the pieces at hand. Each Spark partition packs its own documents in
their order with a bounded number of pieces at hand: no shuffle, no hot group, memory for one batch of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import bounded_batches, documents, query, table, word_vocabulary

SCHEMA = ("doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "segment int, loss_tokens long, sequence_tokens long")


class Packer:
    """Pieces at hand and the sequences made of them.

    A piece is (document, start, length); ``document`` is (id, ids, loss_from, all its tokens). Tokens before
    ``loss_from``, the prompt of instruction data, bear no loss.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, at_hand: int = 256):
        import numpy as np

        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("each limit is at least 1")
        self.np, self.limits, self.at_hand = np, (max_tokens, max_segments, max_loss), at_hand
        self.docs: list[tuple] = []
        self.demand = np.zeros((at_hand + 1, 3))  # tokens, 1, loss-bearing tokens of each piece at hand
        self.scale = 1 / np.array([max_tokens, max_segments, max_loss], float) ** 2

    def loss(self, doc: tuple, start: int, length: int) -> int:
        return max(0, start + length - max(start, doc[2]))

    def fitting(self, doc: tuple, start: int, tokens: int, loss: int) -> int:
        """The longest beginning of a piece with no more than these tokens and loss-bearing tokens."""
        return min(tokens, max(0, doc[2] - start) + loss)

    def put(self, doc: tuple, start: int, length: int) -> None:
        if self.docs:  # what follows the piece in its document comes back to it
            last, begin, more = self.docs[-1]
            if last is doc and begin == start + length and length + more <= self.limits[0]:
                self.docs.pop()
                length += more
        if len(self.docs) == len(self.demand):
            self.demand = self.np.concatenate([self.demand, self.np.zeros_like(self.demand)])
        self.demand[len(self.docs)] = length, 1, self.loss(doc, start, length)
        self.docs.append((doc, start, length))

    def take(self, k: int) -> tuple:
        piece, last = self.docs[k], self.docs.pop()
        if k < len(self.docs):
            self.docs[k], self.demand[k] = last, self.demand[len(self.docs)]
        return piece

    def add(self, doc: tuple):
        """Sequences that are ready now that the document is here."""
        start, total = 0, len(doc[1])
        while total - start >= self.limits[0]:
            length = self.fitting(doc, start, self.limits[0], self.limits[2])
            if length < self.limits[0]:
                break
            yield [(doc, start, length)]
            start += length
        while start < total:
            length = min(total - start, self.limits[0])
            self.put(doc, start, length)
            start += length
            while len(self.docs) >= self.at_hand:
                yield self.sequence()

    def sequence(self) -> list[tuple]:
        """One sequence of the pieces at hand."""
        np, room, made = self.np, self.np.array(self.limits, float), []
        while self.docs and (room[:2] >= 1).all():
            demand = self.demand[:len(self.docs)]
            score = np.where((demand <= room).all(1), demand @ (room * self.scale), -1.0)
            k = int(score.argmax())
            if score[k] >= 0:
                piece = self.take(k)
            else:
                k = int((demand @ (room * self.scale)).argmax())
                doc, start, length = self.docs[k]
                cut = self.fitting(doc, start, min(int(room[0]), length), int(room[2]))
                if cut < 1:
                    break
                self.take(k)
                piece = doc, start, cut
                if cut < length:
                    self.put(doc, start + cut, length - cut)
            made.append(piece)
            room -= (piece[2], 1, self.loss(*piece))
        total = self.limits[0] - int(room[0])
        if total < self.limits[0]:
            over = total - (1 << (total.bit_length() - 1))
            while over:
                doc, start, length = made.pop()
                keep = max(0, length - over)
                over -= length - keep
                self.put(doc, start + keep, length - keep)
                if keep:
                    made.append((doc, start, keep))
        return made

    def rest(self):
        while self.docs:
            yield self.sequence()


def pack_sequences(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                   max_tokens: int = 4096, max_segments: int = 256, max_loss: int = 4096,
                   prompt_tokens: str | None = None) -> DataFrame:
    """Every text as token ids with ``end_id`` behind them, packed into sequences; one row per piece.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers; ``prompt_tokens`` names the column with the
    number of leading tokens without loss (null: none). Sequences get numbers unique over all partitions. A null or
    empty text is its end token alone. A repeated row is packed as often as it occurs; an empty table gives no rows.
    Further columns are ignored. Input order within a partition decides the cuts: give a written table, not the output
    of a shuffle, if a lost executor must see the same order again.
    """
    prompt = F.col(f"`{prompt_tokens}`").cast("long") if prompt_tokens else F.lit(0).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.coalesce(prompt, F.lit(0)).alias("prompt"))
    schema = SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from citespark.llm.tokens import encode_all

        packer = Packer(max_tokens, max_segments, max_loss)
        number = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4")
        names = [part.split()[0] for part in schema.split(", ")]
        out: list[tuple] = []

        def keep(made):
            nonlocal number
            total, offset = sum(p[2] for p in made), 0
            for segment, (doc, start, length) in enumerate(made):
                out.append((doc[0], start, length, doc[1][start:start + length].tobytes(), len(doc[1]), number,
                            offset, segment, packer.loss(doc, start, length), total))
                offset += length
            number += 1

        def flushed(id_type):
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(),
                     pa.int64(), pa.int64()]
            columns = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        id_type = None
        for batch in batches:
            ids, texts, prompts = (batch.column(k) for k in range(3))
            id_type, prompts = ids.type, prompts.to_pylist()
            for k, tokens in encode_all(path, texts):
                doc = ids[k].as_py(), np.concatenate([tokens, end]), prompts[k]
                for made in packer.add(doc):
                    keep(made)
                if len(out) >= 5000:
                    yield flushed(id_type)
        for made in packer.rest():
            keep(made)
        if out:
            yield flushed(id_type)

    return bounded_batches(rows).mapInArrow(run, schema)


def pieces(docs: DataFrame) -> DataFrame:
    """The packing of the query and of the pipeline, with the ids' checksum in place of the ids."""
    made = pack_sequences(docs, word_vocabulary())
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                       "offset", "segment", "loss_tokens", "sequence_tokens")


@query("op1_packing")
def op1(spark, sf_dir):
    """Checked by re-tokenising and a brute-force cover of every document in ``tests/llm/test_packing.py``."""
    return pieces(documents(table(spark, sf_dir, "documents")))
