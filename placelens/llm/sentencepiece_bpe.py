"""SentencePiece BPE encoding by backtracking, and decoding.

Method: an Aho-Corasick automaton gives the longest vocabulary piece that starts
at each place of a chunk. Tokens are laid down greedily; a token is accepted when
re-merging the text of the last token and its own gives back the two of them.
When no prefix of the longest piece is accepted, the place is marked as failed in
a bitfield and the last token is taken back and shortened. The result is the
merge-order encoding, in time linear in the chunk.

Texts are cut into chunks before the automaton sees them, only where no piece of
the vocabulary can reach across (before a run of blanks, around line ends, between
a letter and the marks that no piece has behind one), so the cuts never change the
ids. This is checked when a model is loaded.

Defined results: a null text is encoded as the empty text (no ids); rows are kept
one to one, repeated rows included; an empty table gives an empty table. Only the
id and text columns are read, so that other columns cannot clash.
"""

from __future__ import annotations

import codecs
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

BLANK = "▁"
#: Chunks whose encoding a worker remembers, and pairs of tokens: the first it meets.
MEMO, PAIRS = 200_000, 100_000
NEVER = 1 << 40
#: Bytes of text that a worker turns into arrays at once.
SLICE = 2_000_000


def read_model(path: str) -> bytes:
    """The bytes of a model file (0.5 MB); broadcast to the workers."""
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Pieces and merge order of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        self.texts = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {self.texts[i]: i for i in normal}
        self.byte_ids = [0] * 256
        fallback = [i for i in range(n) if sp.is_byte(i)]
        if len(fallback) != 256:
            raise ValueError("models without byte fallback are not supported")
        for i in fallback:
            self.byte_ids[int(self.texts[i][1:-1], 16)] = i
        scores = {i: sp.get_score(i) for i in normal}
        order = sorted(set(scores.values()), reverse=True)
        level = {s: k for k, s in enumerate(order)}
        #: Merge rank of each piece; equal scores have equal ranks, where the leftmost goes first.
        self.rank = {self.texts[i]: level[scores[i]] for i in normal}
        #: Pairs of characters that stand beside each other in some piece.
        self.beside = {a + b for t in self.ids for a, b in zip(t, t[1:])}
        self.splitter = re.compile(self._pattern(level[order[-1]]))
        # bytes that each id decodes to, control pieces to nothing; then the same as first of a text
        surface = [b"" if sp.is_control(i) else self.texts[i].replace(BLANK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            surface[i] = bytes([b])
        for i in range(n):
            if sp.is_unknown(i):
                surface[i] = " ⁇ ".encode()
        surface += [x[1:] if t.startswith(BLANK) else x for x, t in zip(surface, self.texts)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(x) for x in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        for text in ("", " ", "  two  blanks ", "line\nend", "é́ ﬁ"):
            if sp.encode(text) != encode_slowly(self, text):
                raise ValueError("the model's normalisation is not the identity with a leading blank")

    def _pattern(self, last: int) -> str:
        """Where chunks are cut, as a regular expression of one chunk; blanks are spaces."""
        if any(a != BLANK and b == BLANK for t in self.ids for a, b in zip(t, t[1:])):
            return r"(?s).+"
        line = "\n" if not any("\n" in t and len(t) > 1 for t in self.ids) else ""
        runs = [len(t) for t in self.ids if set(t) == {BLANK} and len(t) > 1]
        pattern = f"{line}|" if line else ""
        if runs and sorted(runs) == list(range(2, max(runs) + 1)) and all(self.rank[BLANK * k] == last for k in runs):
            # such merges come last and from the left, so a longer run starts with the longest of them
            pattern += f" {{{max(runs)}}}(?= )|"
        # marks that follow nothing but marks and blanks in any piece
        marks, size = {c for t in self.ids for c in t if not (c.isalpha() or c in BLANK + "\n")}, 0
        while len(marks) != size:
            size = len(marks)
            marks -= {p[1] for p in self.beside if p[0] != BLANK and p[0] not in marks}
        marks = "".join(map(re.escape, sorted(marks)))
        if not marks:
            return f"(?s){pattern} +[^ {line}]*|[^ {line}]+"
        return f"(?s){pattern} *[^ {line}{marks}]+| *[{marks}]+[^ {line}{marks}]*| +"

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, in order, with spaces for blanks."""
        return self.splitter.findall(" " + text.replace(BLANK, " ")) if text else []


def merge(vocabulary: Vocabulary, text: str) -> list[str]:
    """The pieces of a short text in merge order: lowest rank first, then leftmost."""
    rank, parts = vocabulary.rank, list(text)
    while len(parts) > 1:
        ranks = [rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        best = min(ranks)
        if best == NEVER:
            break
        at = ranks.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def encode_slowly(vocabulary: Vocabulary, text: str) -> list[int]:
    """Plain merging of the whole text; for checks on short texts."""
    if not text:
        return []
    parts = merge(vocabulary, BLANK + text.replace(" ", BLANK))
    return [i for p in parts for i in ([vocabulary.ids[p]] if p in vocabulary.ids else [vocabulary.byte_ids[b] for b in p.encode()])]


class Encoder:
    """Encodes chunks by backtracking; remembers chunks, prefixes and compatible pairs."""

    def __init__(self, model: bytes) -> None:
        self.vocabulary = v = Vocabulary(model)
        self.automaton = ahocorasick.Automaton()
        # a piece that plain merging cannot reach never occurs in an encoding
        for t in v.ids:
            if len(t) == 1 or merge(v, t) == [t]:
                self.automaton.add_word(t, len(t))
        self.automaton.make_automaton()
        #: The longest reachable proper prefix of each token, at last its first character.
        self.shorter: dict[str, str] = {}
        for t in self.automaton:
            n = len(t) - 1
            while n > 1 and t[:n] not in self.automaton:
                n -= 1
            if n:
                self.shorter[t] = t[:n]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, bytes] = {}

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the joint text of two tokens gives these tokens back."""
        found = merge(self.vocabulary, a + b) == [a, b]
        if len(self.pairs) < PAIRS:
            self.pairs[a, b] = found
        return found

    def tokens(self, chunk: str) -> list[str]:
        """The pieces of a chunk; characters outside the vocabulary stand alone."""
        chunk = chunk.replace(" ", BLANK)
        n = len(chunk)
        longest = [1] * n
        for end, size in self.automaton.iter(chunk):  # by growing end, so the last one of a start is the longest
            longest[end - size + 1] = size
        pairs, compatible, shorter = self.pairs.get, self.compatible, self.shorter.get
        failed = 0  # bitfield of places from which no encoding goes on
        token = chunk[: longest[0]]
        out, at, last = [], 0, None
        while True:
            end = at + len(token)
            if not (failed and failed >> end & 1):
                fits = last is None or pairs((last, token))
                if fits or (fits is None and compatible(last, token)):
                    out.append(token)
                    if end == n:
                        return out
                    at, last = end, token
                    token = chunk[at : at + longest[at]]
                    continue
            token = shorter(token)
            while token is None:
                failed |= 1 << at
                at -= len(out[-1])
                token = shorter(out.pop())
                last = out[-1] if out else None

    def ids(self, chunk: str) -> bytes:
        """The ids of a chunk as 32-bit integers."""
        v = self.vocabulary
        try:
            out = [v.ids[t] for t in self.tokens(chunk)]
        except KeyError:
            out = [i for t in self.tokens(chunk) for i in ([v.ids[t]] if t in v.ids else [v.byte_ids[b] for b in t.encode()])]
        return array("i", out).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as 32-bit integers."""
        memo, chunks = self.memo, self.vocabulary.chunks(text)
        out = list(map(memo.get, chunks))
        if None in out:
            for k, found in enumerate(out):
                if found is None:
                    chunk = chunks[k]
                    found = memo.get(chunk)  # met earlier in this text
                    if found is None:
                        found = self.ids(chunk)
                        if len(memo) < MEMO and len(chunk) < 64:
                            memo[chunk] = found
                    out[k] = found
        return b"".join(out)


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


codecs.register_error("placelens.each_byte", _each_byte)


def decode_lists(vocabulary: Vocabulary, flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The texts of lists of ids: pieces joined, byte pieces as UTF-8, the leading blank dropped."""
    which = flat.astype(np.int64)
    which[bounds[:-1][bounds[1:] > bounds[:-1]]] += len(vocabulary.texts)
    size = vocabulary.surface_size[which]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    data = vocabulary.surface[np.repeat(vocabulary.surface_at[which] - (ends - size), size) + np.arange(total)]
    at = np.append(0, ends)[bounds]
    out = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:  # byte pieces that are no UTF-8
        raw = data.tobytes()
        out = pa.array([raw[a:b].decode("utf-8", "placelens.each_byte") for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())
    return out


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of one list of ids."""
    return decode_lists(vocabulary, np.array(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


_loaded: dict[bytes, Encoder] = {}


def worker_encoder(model: bytes) -> Encoder:
    """The encoder of a model, kept for the life of a Python worker."""
    if model not in _loaded:
        _loaded[model] = Encoder(model)
    return _loaded[model]


def slices(sizes: list[int], most: int = SLICE):
    """Ranges of rows of about ``most`` bytes each."""
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encode(documents: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text, one row per input row."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        encoder = worker_encoder(shared.value)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(byte_sizes(texts)):
                blobs = [encoder.encode(t) for t in texts.slice(a, b - a).to_pylist()]
                offsets = np.zeros(len(blobs) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in blobs], out=offsets[1:])
                flat = pa.array(np.frombuffer(b"".join(blobs), np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "ids"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return texts_of(documents, id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of its ids."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        vocabulary = worker_encoder(shared.value).vocabulary
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            for a, b in slices([4 * (n or 0) for n in pa.compute.list_value_length(batch.column(at)).to_pylist()]):
                part = batch.slice(a, b - a)
                lists = part.column(at)
                bounds = np.append(0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))).astype(np.int64)
                texts = decode_lists(vocabulary, lists.flatten().to_numpy(zero_copy_only=False), bounds)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def texts_of(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def byte_sizes(column: pa.Array) -> list[int]:
    """The length of each text in bytes."""
    return pa.compute.binary_length(column).to_pylist()
