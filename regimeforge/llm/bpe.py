"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding never merges the same word twice:

1. Texts are cut into *words* at spaces and newlines that stand between two characters which are not
   white space. The pre-tokeniser's pattern always ends a match there, so a word is one or a few whole
   matches, and matches in different words never depend on each other. The words of a block of
   documents are numbered in order of first use; a text is the sequence of its words' numbers, which
   keeps the positions.
2. Each block's distinct words go, packed, to the hash range of the word. There every distinct word of
   the corpus is encoded once, pattern match by pattern match.
3. The ids return to the blocks that asked and are put in the places of the word's number.

Decoding looks the ids up in the token-byte table, which has a row for each token and does not grow
with the data.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks, common

#: Distinct words that one hash range takes on average.
RANGE_WORDS = 1_000_000
#: Text of a block; its words are Python strings, which take several times that.
BLOCK_BYTES = 6 << 20

_TIGHT = re.compile(r"\s[\s\x1c-\x1f]")
_CUT = re.compile(r"(?<=\S)(?= \S)")
_LINE = re.compile(r"(?<=\S)\n(?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank from a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def cut(text: str) -> list[str]:
    """The words of a text: joined they are the text. Each begins with its space, if it has one."""
    if text.isspace() or _TIGHT.search(text) or text[:1].isspace() or text[-1:].isspace():
        return _CUT.split(text)
    out: list[str] = []
    for k, line in enumerate(text.split("\n")):
        if k:
            out.append("\n")
        head, *rest = line.split(" ")
        out.append(head)
        out += [" " + x for x in rest]
    return out


def _encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _number(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, number of each word of all texts in order, words of each text)."""
    index: dict[str, int] = defaultdict()
    index.default_factory = index.__len__
    numbers, lens = [], []
    for text in texts:
        words = cut(text) if text else []
        numbers.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
        lens.append(len(words))
    return list(index), np.concatenate(numbers), np.array(lens, np.int64)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids), a row for each row of ``docs``: the whole text's token ids as
    little-endian unsigned 32-bit integers in one binary value. With ``decoded`` also what ``decode`` makes of the ids, by the
    Python worker that has put them together.

    Null and empty texts have no ids. Repeated rows and null ids are kept as they are; other columns are
    ignored; an empty table gives an empty result. ``ranks`` must hold all 256 bytes.
    """
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(ranks)
    kept: dict[str, list[bytes | None]] = {}  # of a task: the token-byte table
    size, _ = common.corpus_size(docs)
    n_ranges = max(common.shuffle_partitions(spark), size // (32 * RANGE_WORDS))

    def ask(batches):
        for block, _, texts in blocks.iter_blocks(batches, block_bytes):
            words, _, _ = _number(texts)
            raw = [w.encode() for w in words]
            of = np.fromiter((xxhash.xxh3_64_intdigest(w) % n_ranges for w in raw), np.int64, len(raw))
            order = np.argsort(of, kind="stable")
            held, bounds = blocks.runs(of[order])
            rows = []
            for j, k in enumerate(held.tolist()):
                at = order[bounds[j] : bounds[j + 1]]
                lens = np.fromiter((len(raw[i]) for i in at), np.uint32, len(at))
                rows.append((k, block, blocks.pack_sorted(at.astype(np.uint64)), blocks.pack(blocks.narrow(lens)), _squeeze(b"".join([raw[i] for i in at]))))
            names = ["range", "block", "slots", "lens", "words"]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array([r[j] for r in rows], types[j]) for j in range(5)], names)

    def answer(table: pa.Table) -> pa.Table:
        encode_word = _encoder(vocabulary.value, pattern)
        known: dict[bytes, list[int]] = {}
        out = []
        for row in table.select(["lens", "words"]).to_pylist():
            raw, at, ids, lens = _expand(row["words"]), 0, [], []
            for n in unpack_list(row["lens"]):
                word = raw[at : at + n]
                at += n
                got = known.get(word)
                if got is None:
                    got = known[word] = encode_word(word.decode())
                ids += got
                lens.append(len(got))
            out.append((blocks.pack(blocks.narrow(np.array(lens, np.uint32))), blocks.pack(blocks.narrow(np.array(ids, np.uint32)))))
        return pa.table(
            {"block": table["block"], "slots": table["slots"], "lens": pa.array([x[0] for x in out], pa.binary()), "ids": pa.array([x[1] for x in out], pa.binary())}
        )

    def number(batches):
        for block, ids, texts in blocks.iter_blocks(batches, block_bytes):
            words, numbers, lens = _number(texts)
            yield pa.record_batch(
                [
                    pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([len(words)], pa.int64()),
                    pa.array([blocks.pack(blocks.narrow(lens))], pa.binary()), pa.array([blocks.pack(blocks.narrow(numbers))], pa.binary()),
                ],
                ["block", "ids", "n_words", "lens", "numbers"],
            )

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            raise RuntimeError("ids came back for a block that the second read did not make: the input is not a repeatable scan; write it first")
        row = left.slice(0, 1).to_pylist()[0]
        got = right.to_pydict()
        length = np.zeros(row["n_words"], np.int64)
        parts, slots_of, lens_of = [], [], []
        for s, n, i in zip(got["slots"], got["lens"], got["ids"], strict=True):
            slots_of.append(blocks.unpack_sorted(s).astype(np.int64))
            lens_of.append(blocks.unpack(n).astype(np.int64))
            parts.append(blocks.unpack(i).astype(np.uint32))
        if sum(map(len, slots_of)) != row["n_words"]:
            raise RuntimeError("a block differs between two reads: the input is not a repeatable scan; write it first")
        numbers, lens = blocks.unpack(row["numbers"]).astype(np.int64), blocks.unpack(row["lens"]).astype(np.int64)
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        begin = np.zeros(row["n_words"], np.int64)
        at = 0
        for s, n in zip(slots_of, lens_of, strict=True):
            begin[s] = at + np.cumsum(n) - n
            length[s] = n
            at += int(n.sum())
        ends = np.cumsum(lens)
        ids, counts = [], []
        for lo, hi in zip(ends - lens, ends, strict=True):
            own = numbers[lo:hi]
            n = length[own]
            total = int(n.sum())
            index = np.arange(total) + np.repeat(begin[own] - (np.cumsum(n) - n), n)
            ids.append(flat[index].astype("<u4").tobytes())
            counts.append(total)
        made = {"doc_id": (row["ids"], pa.int64()), "n_tokens": (counts, pa.int64()), "ids": (ids, pa.binary())}
        if decoded:
            if not kept:
                kept["tokens"] = token_table(vocabulary.value)
            made["decoded"] = ([look_up(kept["tokens"], x) for x in ids], pa.binary())
        return blocks.frame(made)

    asked = docs.mapInArrow(ask, "range long, block long, slots binary, lens binary, words binary")
    answered = asked.groupBy("range").applyInArrow(answer, "block long, slots binary, lens binary, ids binary")
    numbered = docs.mapInArrow(number, "block long, ids array<long>, n_words long, lens binary, numbers binary")
    return numbered.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(place, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded)


def unpack_list(blob: bytes) -> list[int]:
    return blocks.unpack(blob).tolist()


def token_table(ranks: dict[bytes, int]) -> list[bytes | None]:
    """The bytes of each token by its id."""
    tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def look_up(tokens: list[bytes | None], raw: bytes | None) -> bytes | None:
    return None if raw is None else b"".join([tokens[i] for i in np.frombuffer(raw, "<u4").tolist()])


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``, which replaces one of that name: the bytes of the tokens, joined. An id without
    a token is an error; null ids give null. The token-byte table is broadcast: it has a row for each token."""
    encoded = encoded.drop("decoded")
    table = encoded.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        tokens = token_table(table.value)
        for batch in batches:
            yield batch.append_column("decoded", pa.array([look_up(tokens, raw) for raw in batch.column(ids).to_pylist()], pa.binary()))

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding, as digests."""
    both = encode(docs, ranks, pattern, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
