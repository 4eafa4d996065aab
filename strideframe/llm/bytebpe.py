"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a rank file: one base64 token and its rank a line.  Its path is a parameter and
only the driver reads it; executors get the model (a few MB, bounded by the file) as a
broadcast.  A token's bytes are written with the byte-to-character table of byte-level BPE, its merge is
recovered by running the merges of lower rank over its own bytes.  Each match of the split pattern is
encoded by itself, without special tokens.

Long texts are cut between an ASCII letter and a blank followed by an ASCII letter: every match of the
pattern ends there, so pieces give the ids of the whole.  Memory follows the pieces, not the text.
Without offsets, ids are looked up by chunks (mostly a blank and the word behind it) that a bounded table keeps
per worker; the library encodes the chunks that are not in it.

Defined cases: null and empty texts have no ids and decode to nothing; a character may be split over
several tokens, whose offsets then all name that character; decoding joins the bytes of all ids
before it reads characters, and bytes that are no UTF-8 become U+FFFD in ``text`` only, never in
``bytes``; unknown ids raise; repeated rows and empty tables need no care, since each row stands alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm.registry import query, table
from strideframe.llm.textkit import slices

PIECE, CHUNKS = 1 << 16, 250_000
_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def byte_table() -> list[str]:
    """The character that stands for each byte: itself if it is printable and no blank, else one from U+0100 on, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that the merges below the token's own rank leave of it."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        options = [(ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(options)
        if rank >= own:
            raise ValueError(f"token {token!r} cannot be merged from tokens of lower rank")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def model_json(path: str, pattern: str) -> str:
    """The tokenizers model of a rank file."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_table()
    spelled = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [tuple(spelled[x] for x in _halves(t, ranks)) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
    model = Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges))
    model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return model.to_str()


_MODELS: dict[str, tuple] = {}


def _loaded(text: str) -> tuple:
    """The model, and the bytes of each id through the reversed byte table; once per Python worker."""
    key = hashlib.sha1(text.encode()).hexdigest()
    if key not in _MODELS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        back = {c: b for b, c in enumerate(byte_table())}
        vocabulary = json.loads(text)["model"]["vocab"]
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            tokens[i] = bytes(back[c] for c in word)
        _MODELS[key] = Tokenizer.from_str(text), tokens
    return _MODELS[key]


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > 2 * PIECE:
        cut = _CUT.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


#: Between a non-blank and a single blank before a non-blank, and between a letter or digit and a stop or
#: comma, every match of the pattern ends.
_EDGE = re.compile(r"(?<=\S)(?= \S)|(?<=[^\W_])(?=[.,])")
#: A chunk that is one match of the pattern whatever the Unicode version.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


class _Chunks(dict):
    """The ids of chunks as 32-bit integers in bytes; emptied when it holds ``CHUNKS`` of them."""

    def __init__(self, tokenizer):
        chars = byte_table()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.spelling = {i: "".join(chars[b] for b in chr(i).encode()) for i in range(256)}

    def learn(self, chunks: set[str]) -> None:
        one = [c for c in chunks if _PLAIN(c)]
        for c in one:
            self[c] = np.array([t.id for t in self.model.tokenize(c.translate(self.spelling))], np.int32).tobytes()
        rest = [c for c in chunks if c not in self]
        for lo in range(0, len(rest), 4096):
            part = rest[lo : lo + 4096]
            self.update(zip(part, (np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))

    def codes(self, texts: list[str]) -> list[bytes]:
        rows = [_EDGE.split(t) for t in texts]
        if len(self) > CHUNKS:
            self.clear()
        self.learn({c for row in rows for c in row if c not in self})
        return [b"".join([self[c] for c in row]) for row in rows]


def _encoder(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Chunks(_loaded(model.value)[0])
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows = [b"".join(held.codes([p])[0] for p in _pieces(t)) if t and len(t) > 2 * PIECE else t for t in batch.column("text").to_pylist()]
            short = iter(held.codes([r for r in rows if r and isinstance(r, str)]))
            codes = [r if isinstance(r, bytes) else next(short) if r else b"" for r in rows]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(c) // 4 for c in codes])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(codes), np.int32)))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """doc_id, ids; with ``offsets`` also first and last, each token's range of characters of the text."""
    model = docs.sparkSession.sparkContext.broadcast(model_json(ranks_path, pattern))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]

    def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, _ = _loaded(model.value)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            codes, spans, count = [np.zeros(0, np.int32)], [np.zeros((0, 2), np.int64)], np.zeros(batch.num_rows, np.int64)
            for row, t in enumerate(batch.column("text").to_pylist()):
                base = 0
                for piece in _pieces(t or ""):
                    e = tokenizer.encode(piece, add_special_tokens=False)
                    codes.append(np.array(e.ids, np.int32))
                    spans.append(np.array(e.offsets, np.int64).reshape(-1, 2) + base)
                    count[row] += len(e.ids)
                    base += len(piece)
            ends, span = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), np.concatenate(spans)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x))) for x in (np.concatenate(codes), span[:, 0], span[:, 1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "ids", "first", "last"])

    if offsets:
        return source.mapInArrow(spanned, f"doc_id {kind}, ids array<int>, first array<long>, last array<long>")
    return source.mapInArrow(_encoder(model), f"doc_id {kind}, ids array<int>")


def _decoder(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tokens = _loaded(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                column = batch.column("ids")
                raw = [b"".join([tokens[i] for i in column[k].values.to_numpy().tolist()]) if column[k].is_valid else b"" for k in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, pa.array(raw, pa.binary())], ["doc_id", "ids", "bytes"])

    return run


def decode(encoded: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, ids, bytes, text: the ids back through the reversed byte table."""
    model = encoded.sparkSession.sparkContext.broadcast(model_json(ranks_path, pattern))
    source = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    out = source.mapInArrow(_decoder(model), f"doc_id {dict(source.dtypes)['doc_id']}, ids array<int>, bytes binary")
    return out.withColumn("text", F.expr("make_valid_utf8(cast(bytes as string))"))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256 of whole texts.

    Encoder and decoder run in one Python pass, so that a task has one worker and one model.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_json(ranks_path, pattern))
    source = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    there, back = _encoder(model), _decoder(model)
    decoded = source.mapInArrow(lambda batches: back(there(batches)), f"doc_id {dict(source.dtypes)['doc_id']}, ids array<int>, bytes binary")
    return decoded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


@query("op7_byte_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """All documents through the public 50k vocabulary."""
    import public_tokenizers

    return round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("ids")
