"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is marked (a leading mark, spaces as marks) and cut into words, each a mark run with what follows;
no piece reaches across a cut. Words are cut and gathered on the bytes of a slice of texts; only a distinct
word that the worker doesn't remember is looked at by itself. Those are sorted, which lays them out as a trie in
depth-first order, and the forward pass walks that trie: the state of every prefix is computed once and
reused by all words that share it. Two state rules:

* unigram models: Viterbi. A prefix's score is the best sum of piece scores that spells it.
* BPE models (as the one at hand): Viterbi over merge scores would give other pieces than the merges do,
  so a step from one piece to the next is allowed only if merging their joint string gives just the two.
  Exactly one path of allowed steps spells each prefix, and it is the encoding the merges produce; a
  prefix's state is the last piece of that path. Words that begin with several marks are merged plainly, by
  a heap; the middle of a long run of marks is the longest piece of marks again and again, which is
  made sure of for the vocabulary when it is loaded.

Characters outside the vocabulary become byte pieces, or the unknown piece where there are none.

Decoding joins the pieces' bytes and drops the leading mark.

Edge cases: null and empty texts have no ids and decode to the empty text. A literal mark character in
a text decodes to a space, as with the library; `lossless` tells. Repeated rows encode alike.
"""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as B
from .wordmemory import WordMemory, ragged

MARK = "▁"
#: The name by which a worker keeps its codec between tasks.
OWN = "pieces"
#: Pairs of pieces that a worker remembers; beyond that it starts afresh. Results don't depend on it.
REMEMBERED = 200_000
#: States of prefixes that a worker remembers at the start of a batch of words.
STATES = 300_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _State:
    """What the forward pass of a BPE model knows of a prefix: its longest end that begins a piece, and the last pieces of the paths to where that end starts and on."""

    __slots__ = ("tail", "recent", "ids", "n", "to")

    def __init__(self, tail: str, recent: tuple[str, ...], ids: list[int]):
        self.tail, self.recent, self.ids, self.n, self.to = tail, recent, ids, len(recent[-1]), {}


def _shared(words: list[str], most: int = 32) -> list[int]:
    """How many first characters (`most` at most) each sorted word has in common with the one before it."""
    if not words:
        return []
    a = np.array([w[:most] for w in words])
    a = np.ascontiguousarray(a).view(np.uint32).reshape(len(words), -1)
    same = np.concatenate((a[1:] == a[:-1], np.zeros((len(words) - 1, 1), bool)), axis=1)
    size = np.array([len(w) for w in words])
    return [0, *np.minimum(np.argmin(same, axis=1), np.minimum(size[1:], size[:-1])).tolist()]


class Codec:
    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        self.unk = sp.unk_id()
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.spelled = [b""] * n
        for p, i in self.ids.items():
            self.spelled[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.spelled[i] = bytes([b])
        self.spelled[self.unk] = " ⁇ ".encode()
        # merge scores of BPE models are the negated ranks of the pieces
        multi = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.score[p])
        self.bpe = bool(multi) and all(float(self.score[p]).is_integer() for p in multi)
        used = {c for p in multi for c in p}
        apart = "".join(chr(c) for c in range(128) if chr(c) not in used)
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        # bytes that stand for themselves, and whether words may be cut at all
        self.alone, self.whole = np.zeros(256, bool), inner
        self.alone[[ord(c) for c in apart if c != " "]] = not inner
        by_end: dict[str, set[int]] = {}
        for p in self.ids:
            by_end.setdefault(p[-2:], set()).add(len(p))
        singles = {k for k in by_end if len(k) == 1}
        self.ends = {k: tuple(sorted(v | ({1} if k[-1] in singles else set()), reverse=True)) for k, v in by_end.items()}
        self.memory = WordMemory(1 << 20, 1 << 22)
        self.steps: dict[tuple[str, str], bool] = {}
        self.states: dict[tuple[str, tuple[str, ...]], _State] = {}
        self.starts = {p[:n]: p[:n] for p in self.ids for n in range(1, len(p))}
        self.coded_as: dict[str, list[int]] = {}
        self.bytes_of = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.bytes_size = np.array([len(x) for x in self.spelled], np.int64)
        self.bytes_start = np.cumsum(self.bytes_size) - self.bytes_size
        runs = [len(p) for p in self.ids if set(p) == {MARK}]
        self.run = max(runs, default=1)
        #: Runs of marks beyond this are shortened by `run` marks at a time, if that is right for this vocabulary.
        self.most = 4 * self.run
        if self.bpe and any(self.merge(MARK * (n + self.run)) != [MARK * self.run, *self.merge(MARK * n)] for n in range(self.most - self.run, self.most + self.run)):
            self.most = 1 << 62

    # ---- merges, as the reference point of the BPE rule
    def merge(self, word: str) -> list[str]:
        """The pieces (or lone characters) that merging the best-scored neighbours, leftmost first, leaves."""
        parts: list[str | None] = list(word)
        if len(parts) < 48:
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    s = self.score.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(-s, i, a + b) for i, (a, b) in enumerate(zip(word, word[1:])) if (s := self.score.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != len(p):
                continue
            parts[i], parts[j], after[i] = p, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for at in (before[i], i):
                if at >= 0 and after[at] < len(parts):
                    q = parts[at] + parts[after[at]]
                    if (s := self.score.get(q)) is not None:
                        heapq.heappush(heap, (-s, at, q))
        return [p for p in parts if p is not None]

    def _marked_merge(self, word: str) -> list[str]:
        """The same for a word that begins with several marks."""
        spare = max(0, len(word) - len(word.lstrip(MARK)) - self.most + self.run - 1) // self.run
        return [MARK * self.run] * spare + self.merge(word[spare * self.run :])

    def step(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a in a BPE encoding; a is empty at the start of a word."""
        key = (a, b)
        ok = self.steps.get(key)
        if ok is None:
            if len(self.steps) > REMEMBERED:
                self.steps.clear()
            ok = self.steps[key] = self.merge(a + b) == ([a, b] if a else [b])
        return ok

    # ---- the forward pass over the sorted words
    def forward(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words by a depth-first walk of their trie: the order in which they come, their ids in a row, and how many each has."""
        order = sorted(range(len(words)), key=words.__getitem__)
        backwards: list[int] = []  # ids of the words so far, from the last piece of each to its first
        size = np.zeros(len(words), np.int64)
        path: list = [self.root() if self.bpe else ("", 0, 0.0)]  # path[i]: the state of the word's prefix of length i
        walk = self._walk_bpe if self.bpe else self._walk_unigram
        plain = [i for i in order if not (self.bpe and words[i].startswith(MARK + MARK))]
        for i, shared in zip(plain, _shared([words[i] for i in plain])):
            had = len(backwards)
            walk(words[i], shared, path, backwards)
            size[i] = len(backwards) - had
        marked = [i for i in order if self.bpe and words[i].startswith(MARK + MARK)]
        for i in marked:
            got = [x for p in self._marked_merge(words[i]) for x in self.coded(p)]
            backwards.extend(reversed(got))
            size[i] = len(got)
        done = np.array(plain + marked, np.int64)[::-1]
        return done, np.array(backwards, np.int32)[::-1], size[done]

    def coded(self, piece: str) -> list[int]:
        """A piece's id; a lone character outside the vocabulary as byte pieces, or the unknown piece."""
        got = self.ids.get(piece)
        return [got] if got is not None else [self.byte[b] for b in piece.encode()] if self.byte else [self.unk]

    def root(self) -> _State:
        """The state of the empty prefix. States are kept between calls, up to so many."""
        if not self.states or len(self.states) > STATES:
            self.states = {("", ("",)): _State("", ("",), [])}
        return self.states["", ("",)]

    def _next(self, state: _State, c: str) -> _State:
        """The state that a character leads to: the longest piece that ends here and may follow the path to where it starts."""
        text, piece = state.tail + c, c
        for at in range(len(text)):
            if text[at:] in self.ids and self.step(state.recent[at], text[at:]):
                piece = text[at:]
                break
        cut = next((at for at in range(len(text)) if text[at:] in self.starts), len(text))
        tail = text[cut:]
        key = (self.starts.get(tail, tail), (*state.recent, piece)[cut:])
        got = self.states.get(key)
        if got is None:
            ids = self.coded_as.get(piece)
            if ids is None:
                ids = self.coded(piece)[::-1]
                if len(self.coded_as) < 2 * len(self.ids):
                    self.coded_as[piece] = ids
            got = self.states[key] = _State(*key, ids)
        state.to[c] = got
        return got

    def _walk_bpe(self, word: str, shared: int, path: list[_State], backwards: list[int]) -> None:
        del path[shared + 1 :]
        state = path[-1]
        for c in word[shared:]:
            state = state.to.get(c) or self._next(state, c)
            path.append(state)
        i = len(word)
        while i:
            state = path[i]
            backwards += state.ids
            i -= state.n

    def _walk_unigram(self, word: str, shared: int, path: list[tuple[str, int, float]], backwards: list[int]) -> None:
        del path[shared + 1 :]
        for i in range(shared + 1, len(word) + 1):
            piece = word[i - 1]
            top, size = path[i - 1][2] - 1e6, 1
            for n in self.ends.get(word[max(0, i - 2) : i]) or self.ends.get(piece) or ():
                if n <= i and (p := word[i - n : i]) in self.ids and path[i - n][2] + self.score[p] > top:
                    top, size, piece = path[i - n][2] + self.score[p], n, p
            path.append((piece, size, top))
        i = len(word)
        while i:
            backwards += reversed(self.coded(path[i][0]))
            i -= path[i][1]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts in a row, and where each text's ids begin (texts + 1)."""
        mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
        if len(mark):  # a literal mark is a space
            data, offsets = data.copy(), offsets - 2 * np.searchsorted(mark, offsets)
            data[mark] = 32
            data = np.delete(data, np.concatenate((mark + 1, mark + 2)))
        full = offsets[:-1] < offsets[1:]
        data = np.insert(data, offsets[:-1][full], 32)
        offsets = offsets + np.concatenate(([0], np.cumsum(full)))
        begin = np.zeros(len(data), bool)
        if not self.whole and len(data):
            space, alone = data == 32, self.alone[data]
            begin |= alone
            begin[1:] |= alone[:-1] | (space[1:] & ~space[:-1])
        begin[offsets[:-1][full]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        return self.memory.encode(data, starts, ends, np.searchsorted(starts, offsets), lambda ws: self.forward([w.replace(" ", MARK) for w in ws]))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that each text's ids spell, without the leading mark, in a row, and where each text begins."""
        size = self.bytes_size[ids]
        raw = ragged(self.bytes_of, self.bytes_start[ids], size)
        upto = np.concatenate(([0], np.cumsum(size)))[offsets]
        full = np.flatnonzero(upto[:-1] < upto[1:])
        lead = full[raw[upto[full]] == 32]
        gone = np.zeros(len(upto), np.int64)
        gone[lead + 1] = 1
        return np.delete(raw, upto[lead]), upto - np.cumsum(gone)

    def texts(self, raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts as an Arrow column; bytes that are no UTF-8 become the replacement character."""
        inner = offsets[(offsets > 0) & (offsets < len(raw))]
        try:
            raw.tobytes().decode()
            sound = not ((raw[inner] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            sound = False
        if sound and len(raw) < 1 << 31:
            return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw))
        return pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets.tolist(), offsets[1:].tolist())], pa.string())


@cache
def codec(path: str) -> Codec:
    """One codec a worker and model, until the worker is given another operator's task."""
    B.keeping(OWN, codec.cache_clear)
    return Codec(path)


def encode(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with `ids` (array<int>) of every whole text."""

    def scorer():
        def f(data, offsets, col):
            ids, at = codec(path).encode(data, offsets)
            return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]

        return f

    return B.annotate(df, text_col, [T.StructField("ids", T.ArrayType(T.IntegerType()))], scorer, keep, OWN)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of every array of ids."""
    schema = T.StructType([f for f in df.schema if f.name != out] + [T.StructField(out, T.StringType())])
    names = [f.name for f in schema]

    def run(batches):
        B.take_over(OWN)
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, B.SLICE_ROWS):
                part = batch.slice(at, B.SLICE_ROWS)
                col = part.column(part.schema.get_field_index(ids_col))
                size = np.array(pc.fill_null(pc.list_value_length(col), 0), np.int64)
                ids = np.array(pc.list_flatten(col), np.int64)
                text = c.texts(*c.decode(ids, np.concatenate(([0], np.cumsum(size)))))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names[:-1]] + [text], names=names)

    return df.mapInArrow(run, schema)


def coded(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with ids, their number, the digest of the decoded text and whether it is the text again, in one pass."""

    def scorer():
        import hashlib

        def f(data, offsets, col):
            c = codec(path)
            ids, at = c.encode(data, offsets)
            raw, to = c.decode(ids, at)
            if len(raw) == len(data) and (to == offsets).all() and (raw == data).all():
                same = np.ones(len(col), bool)
            else:
                col = c.texts(raw, to)
                own = data
                raw, to = B.column_bytes(col)
                same = np.array([np.array_equal(raw[a:b], own[x:y]) for a, b, x, y in zip(to.tolist(), to[1:].tolist(), offsets.tolist(), offsets[1:].tolist())], bool)
            view = memoryview(np.ascontiguousarray(raw))
            digest = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(to.tolist(), to[1:].tolist())]
            return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), np.diff(at), digest, same]

        return f

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())]
    return B.annotate(df, text_col, fields, scorer, keep, OWN)


def op7(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's ids, and what they decode to."""
    return coded(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or model_path(), keep=["doc_id"])


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id, ids and their number of every row of docs.

    Null and empty texts have no ids, rows without an id and repeated rows are encoded like any, texts are
    encoded whole. An empty table gives an empty one.
    """
    return encode(docs, model_path(), keep=["doc_id"]).withColumn("n_tokens", F.size("ids").cast("long"))
