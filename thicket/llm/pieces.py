"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text's best segmentation maximises the sum of its pieces' scores: a shortest-path recurrence over positions, linear in
the (max, +) semiring. Its state at a chunk's edge is how far the piece that crosses the edge reaches into the next chunk,
so a chunk acts on states as a small matrix. Giant documents are cut into chunks; every chunk's matrix is computed on its
own, the matrices of a document are folded from left to right into the score vector at each edge, and each chunk is then
backtraced on its own from those vectors. The vocabulary is read as a unigram model: of a BPE file the scores are merge ranks,
so ids can differ from those of that model's own encoder.

Defined results: a null text has null ids, an empty text no ids. Every text decodes to itself. Scores are the vocabulary's;
among equal sums the segmentation whose last cut lies furthest left wins, then the last but one, and so on, whatever the
chunk size. A character that no piece holds, and a literal U+2581, becomes its UTF-8 bytes' pieces. Rows repeat if they
repeat in the input; other columns stay as they are, except that columns named like the added ones are replaced.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UID, Remembered, checkpointed, with_uid, workers_find_package

SPACE = "▁"
#: Stands for a literal U+2581 of a text while it is segmented: a space, as the text's own spaces are marks by then.
LITERAL = " "
SWAPPED = str.maketrans(f"{SPACE} ", f"{LITERAL}{SPACE}")
LOW = float("-inf")


class Vocabulary:
    """Pieces and scores of a SentencePiece model file, and segmentation of short strings."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of = []
        self.byte_id = {}
        self.piece = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.piece[piece] = (model.get_score(i), i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.piece))
        self.prefixes: dict = {}
        for piece, (score, _) in self.piece.items():
            at = self.prefixes
            for c in piece[:-1]:
                at = at.setdefault(c, (None, {}))[1]
            at[piece[-1]] = (score, at[piece[-1]][1] if piece[-1] in at else {})
        self.unknown = min(score for score, _ in self.piece.values()) - 10
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", piece) for piece in self.piece):
            raise ValueError("a piece goes on past the end of a word")
        # No piece goes from another character to a space mark or holds a line end: words are independent.
        self.word = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.known = Remembered(self.encode_word)

    def ids(self, unit: str, piece: tuple | None) -> list[int]:
        if piece:
            return [piece[1]]
        return [self.byte_id[b] for b in (SPACE if unit == LITERAL else unit).encode()]

    def arcs(self, text: str, end: int):
        """(start, stop, score) of each piece or single unknown character that ends at `end`, longest first."""
        known = False
        for start in range(max(0, end - self.longest), end):
            if (found := self.piece.get(text[start:end])) is not None:
                known |= start == end - 1
                yield start, found[0]
        if not known:
            yield end - 1, self.unknown

    def forward(self, text: str, entry: list[float], body: int) -> tuple[list[float], list[int]]:
        """Best score and last cut at each position, given scores at the first positions; pieces start before `body`."""
        best = entry + [LOW] * (len(text) + 1 - len(entry))
        back = [-1] * len(best)
        for end in range(1, len(text) + 1):
            top, cut = best[end], -1
            for start, score in self.arcs(text, end):
                if start < body and best[start] + score > top:
                    top, cut = best[start] + score, start
            best[end], back[end] = top, cut
        return best, back

    def trace(self, text: str, back: list[int], end: int) -> tuple[list[int], int]:
        """Ids of the path to `end`, and the position where it entered."""
        out: list[list[int]] = []
        while back[end] >= 0:
            unit = text[back[end] : end]
            out.append(self.ids(unit, self.piece.get(unit)))
            end = back[end]
        return [i for ids in reversed(out) for i in ids], end

    def cuts(self, body: str) -> tuple[int, int] | None:
        """The first and the last place inside body that no piece crosses."""
        first = re.search(f"(?<=[^{SPACE}]){SPACE}|(?<=.)\n|(?<=\n).", body, re.DOTALL)
        if not first:
            return None
        last = body.rfind(SPACE)
        while last > 0 and body[last - 1] == SPACE:
            last = body.rfind(SPACE, 0, last)
        return first.start(), max(last, body.rfind("\n", 0, len(body) - 1) + 1, first.start())

    def encode_word(self, word: str) -> bytes:
        """The ids that forward() and trace() give for a word on its own, following pieces along a prefix tree."""
        n, root, piece, unknown = len(word), self.prefixes, self.piece, self.unknown
        best, back = [LOW] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            so_far, end, at = best[start], start, root
            for c in word[start : start + self.longest]:
                step = at.get(c)
                if step is None:
                    break
                end += 1
                score, at = step
                if score is not None and so_far + score > best[end]:
                    best[end], back[end] = so_far + score, start
            if word[start] not in piece and so_far + unknown > best[start + 1]:
                best[start + 1], back[start + 1] = so_far + unknown, start
        out, end = [], n
        while end:
            unit = word[back[end] : end]
            out.append(self.ids(unit, piece.get(unit)))
            end = back[end]
        return array("i", [i for ids in reversed(out) for i in ids]).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        return b"".join(map(self.known.__getitem__, self.word.findall(marked(text))))


def marked(text: str) -> str:
    """text with space marks for spaces and before its start."""
    return SPACE + (text.translate(SWAPPED) if SPACE in text else text.replace(" ", SPACE)) if text else ""


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _id_columns(found: list[bytes | None]) -> list[pa.Array]:
    """ids, n_tokens and ids_crc32 of rows' little-endian ids; None for a null text."""
    null = np.array([x is None for x in found], dtype=bool)
    offsets = np.concatenate([[0], np.cumsum([len(x or b"") // 4 for x in found])]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(x for x in found if x), dtype="<i4"))
    ids = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)), values)
    return [ids, pa.array([None if x is None else len(x) // 4 for x in found], pa.int64()), pa.array([None if x is None else zlib.crc32(x) for x in found], pa.int64())]


def encode_documents(docs: DataFrame, model: str, chunk_chars: int = 1 << 16) -> DataFrame:
    """docs with ids array<int>, n_tokens long and ids_crc32 long of its column text."""
    workers_find_package(docs.sparkSession)
    docs = docs.drop("ids", "n_tokens", "ids_crc32")
    fields = [*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields)
    small = docs.filter(F.col("text").isNull() | (F.length("text") <= chunk_chars))

    def encode(batches):
        words = vocabulary(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [None if x is None else words.encode(x) for x in texts.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *_id_columns(found)], names=schema.names)

    return small.mapInArrow(encode, schema).unionByName(_encode_giants(docs.filter(F.length("text") > chunk_chars), model, chunk_chars, schema))


def _encode_giants(docs: DataFrame, model: str, size: int, schema: T.StructType) -> DataFrame:
    """encode_documents for texts of more than one chunk."""
    docs = checkpointed(with_uid(docs))
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    text = F.concat(F.lit(SPACE), F.translate("text", f"{SPACE} ", f"{LITERAL}{SPACE}"))
    chunks = (
        docs.select(UID, text.alias("text"))
        .select(UID, "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size))).alias("chunk"))
        .select(UID, "chunk", F.expr(f"substring(text, int(chunk * {size} + 1), {size})").alias("body"), F.expr(f"substring(text, int((chunk + 1) * {size} + 1), 64)").alias("ahead"))
    )

    def matrices(batches):
        words = vocabulary(model)
        for batch in batches:
            found = [_matrix(words, r["body"], r["ahead"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=[UID, "chunk", "matrix"])

    def scan(pdf):
        pdf = pdf.sort_values("chunk")
        vector, vectors = None, []
        for m in pdf.matrix:
            size = int(len(m) ** 0.5)
            vector = np.array([0.0] + [LOW] * (size - 1)) if vector is None else vector
            vectors.append(vector.tolist())
            vector = np.max(vector[:, None] + np.asarray(m, dtype=float).reshape(size, size), axis=0)
        return pdf[[UID, "chunk"]].assign(entry=vectors)

    def crossings(batches):
        words = vocabulary(model)
        for batch in batches:
            rows = [(r[UID], r["chunk"], s, enter) for r in batch.to_pylist() for s, enter in enumerate(_entered(words, r["body"], r["ahead"], r["entry"]))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=[UID, "chunk", "leave", "enter"])

    def walk(pdf):
        """The state at each chunk's end, followed from the document's end."""
        to = {(c, s): e for c, s, e in zip(pdf.chunk, pdf.leave, pdf.enter)}
        last = int(pdf.chunk.max())
        out, state = [], 0
        for c in range(last, -1, -1):
            out.append((c, state))
            state = to[(c, state)]
        return pdf.iloc[: len(out)][[UID]].assign(chunk=[c for c, _ in out], leave=[s for _, s in out])

    def emit(batches):
        words = vocabulary(model)
        for batch in batches:
            rows = [(r[UID], r["chunk"], _part(words, r["body"], r["ahead"], r["entry"], r["leave"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=[UID, "chunk", "part"])

    entries = chunks.select(UID, "chunk", "body", "ahead").mapInArrow(matrices, f"{UID} long, chunk long, matrix array<double>").groupBy(UID).applyInPandas(scan, f"{UID} long, chunk long, entry array<double>")
    entered = checkpointed(chunks.join(entries, [UID, "chunk"]))
    leaves = entered.mapInArrow(crossings, f"{UID} long, chunk long, leave int, enter int").groupBy(UID).applyInPandas(walk, f"{UID} long, chunk long, leave int")
    parts = entered.join(leaves, [UID, "chunk"]).mapInArrow(emit, f"{UID} long, chunk long, part array<int>")
    whole = parts.groupBy(UID).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"])).alias("ids"))

    def digest(batches):
        for batch in batches:
            found = [np.asarray(x, dtype="<i4").tobytes() for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_id_columns(found)], names=schema.names)

    return docs.join(whole, UID).select(*schema.names[:-3], "ids").mapInArrow(digest, schema)


def _edges(words: Vocabulary, body: str, ahead: str) -> tuple[str, str, str, int]:
    """A chunk's text up to its first cut, that between its cuts, that from its last cut on with what a piece may reach into, and how much of that is the chunk's own. Without a cut, all is in the last."""
    ahead = ahead[: words.longest - 1]
    first, last = words.cuts(body) or (0, 0)
    return body[:first], body[first:last], body[last:] + ahead, len(body) - last


def _matrix(words: Vocabulary, body: str, ahead: str) -> list[float]:
    """The chunk's action on states, row by row, less the constant score between its cuts, which no comparison sees."""
    head, _, tail, own = _edges(words, body, ahead)
    width = words.longest
    row = lambda text, state, inner: words.forward(text, [LOW] * state + [0.0], inner)[0] if state <= len(text) else [LOW] * (len(text) + 1)
    exits = lambda best: (best[own:] + [LOW] * width)[:width]
    if not head:
        return [x for s in range(width) for x in exits(row(tail, s, own))]
    leave = exits(row(tail, 0, own))
    return [row(head, s, len(head))[-1] + x for s in range(width) for x in leave]


def _entered(words: Vocabulary, body: str, ahead: str, entry: list[float]) -> list[int]:
    """For each state at the chunk's end, that at its start on the best path."""
    head, _, tail, own = _edges(words, body, ahead)
    if head:
        return [words.trace(head, words.forward(head, list(entry)[: len(head) + 1], len(head))[1], len(head))[1]] * (len(tail) - own + 1)
    _, back = words.forward(tail, list(entry)[: len(tail) + 1], own)
    enter = []
    for at, cut in enumerate(back):
        enter.append(at if cut < 0 else enter[cut])
    return enter[own:]


def _part(words: Vocabulary, body: str, ahead: str, entry: list[float], leave: int) -> list[int]:
    """Ids of the pieces that start in the chunk."""
    head, middle, tail, own = _edges(words, body, ahead)
    start = list(entry)
    out = []
    if head:
        out = words.trace(head, words.forward(head, start[: len(head) + 1], len(head))[1], len(head))[0]
        out += [i for word in words.word.findall(middle) for i in np.frombuffer(words.known[word], dtype="<i4").tolist()]
        start = [0.0]
    return out + words.trace(tail, words.forward(tail, start[: len(tail) + 1], own)[1], own + leave)[0]


def decode_documents(encoded: DataFrame, model: str, column: str = "decoded") -> DataFrame:
    """encoded with the text of its column ids; null for null ids."""
    workers_find_package(encoded.sparkSession)
    encoded = encoded.drop(column)
    schema = T.StructType([*encoded.schema.fields, T.StructField(column, T.StringType())])

    def decode(batches):
        words = vocabulary(model)
        spelled = pa.array(words.bytes_of, pa.binary())
        for batch in batches:
            texts = []
            for at in range(0, len(batch), 256):
                ids = batch.column(batch.schema.get_field_index("ids")).slice(at, 256)
                counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                units = spelled.take(ids.flatten())
                ends = np.frombuffer(units.buffers()[1], dtype=np.int32, count=len(units) + 1) if len(units) else np.zeros(1, np.int32)
                joined, bounds = (units.buffers()[2] or b"", ends[np.concatenate([[0], np.cumsum(counts)])].tolist())
                valid = ids.is_valid().to_pylist()
                texts += [bytes(joined[i:j]).decode(errors="replace")[1:] if ok else None for i, j, ok in zip(bounds, bounds[1:], valid)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(decode, schema)
