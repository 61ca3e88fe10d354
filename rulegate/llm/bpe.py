"""Byte-level BPE by prefix-sharing trie traversal.

The distinct words of a block of texts, in sorted order, are the depth-first order of their trie: the words
below a node are neighbours, and a word only adds the nodes after the prefix it shares with the one before.
Each node holds one state, the last token of the encoding of its prefix. It follows from the states above:
the last token is the suffix token t whose boundary with the last token of the rest survives all merges, and
exactly one token does. So a prefix shared by many words is encoded once, a word's tokens are read off by
stepping back from its node, and no merge loop runs per word. Time is linear in the bytes of new nodes.

Words come from a vectorised split over classes of code points that equals the byte-level pattern; texts
with code points Python's Unicode tables do not know yet are split by the tokenizer library's own splitter.

Defined results: a null text is an empty one (no ids); added special tokens written out in a text become their
id, as the tokenizer library does by default; unknown ids decode to nothing; bytes that are no UTF-8 decode to
U+FFFD. Empty tables give empty tables; repeated rows stay repeated; only the named columns are carried. Texts are
taken in runs of bounded size and memos are bounded by bytes, so a worker's memory does not grow with its input.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from rulegate.llm.common import by_value

by_value(__name__)

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 4

# Code points with the White_Space property
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings split off after an apostrophe, in the order the pattern tries them
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

# Memory bounds of a task; reaching one empties a memo or ends a run of texts and changes no result
MEMO_BYTES = 64 << 20
WORD_COST = 180  # bytes an entry of the memo takes beside its characters
PAIRS_KEPT = 150_000
CHARS_AT_ONCE = 400_000
IDS_AT_ONCE = 400_000

# A cut before white space that follows other text leaves all words as they are
CUT = re.compile("(?<=[^{0}])[{0}]".format("".join(f"\\u{p:04x}" for p in WHITE_SPACE)))


def classes() -> np.ndarray:
    """Class of every code point."""
    of = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (
            UNKNOWN if (c := unicodedata.category(chr(p))) == "Cn" else of.get(c[0], OTHER)
            for p in range(0x110000)
        ),
        np.uint8,
        0x110000,
    )
    table[WHITE_SPACE] = SPACE
    return table


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the
    others by the code points from 256 on, in byte order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Tables of a byte-level BPE tokenizer file: small (one entry per token), read once on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
    flags = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if not plain or not pre.get("use_regex", True) or spec.get("normalizer") or flags or model.get("ignore_merges"):
        raise ValueError("only byte-level BPE without normaliser, prefix space and token flags is supported")
    alphabet = byte_alphabet()
    raw = lambda token: bytes(alphabet[c] for c in token)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ids = {raw(t): i for t, i in model["vocab"].items() if t not in added}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = [(ids[raw(a)], ids[raw(b)], ids[raw(a + b)]) for a, b in pairs]
    if len({m[2] for m in merges}) != len(merges):
        raise ValueError("a token is made by two merges")
    return {"ids": ids, "merges": merges, "added": added}


class Codec:
    """Encoder and decoder over one vocabulary; lives in a task."""

    def __init__(self, vocabulary: dict):
        self.ids: dict[bytes, int] = vocabulary["ids"]
        self.added: dict[str, int] = vocabulary["added"]
        size = 1 + max([*self.ids.values(), *self.added.values()])
        self.size = size
        self.rank = {}
        self.born = [-1] * size
        self.left, self.right = list(range(size)), list(range(size))
        for rank, (a, b, made) in enumerate(vocabulary["merges"]):
            self.rank[a * size + b] = rank
            self.born[made], self.left[made], self.right[made] = rank, a, b
        ends: dict[bytes, set[int]] = {}
        for token in self.ids:
            if len(token) > 2:
                ends.setdefault(token[-3:], set()).add(len(token))
        #: Lengths of the tokens that can end in three bytes; the order is free, as only one token fits.
        self.ends = {k: [*sorted(v), *([2] if k[1:] in self.ids else []), 1] for k, v in ends.items()}
        self.survives: dict[int, bool] = {}
        self.classes = classes()
        self.slow = None
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.flat, self.at = array("i"), array("q", [0])
        self.held = 0

    # ---- splitting -----------------------------------------------------------------------------

    def split(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Words of all texts in order, and the number of words of each text."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(points)
        if not n:
            return [], np.zeros(len(texts), np.int64)
        ends = np.cumsum([len(t) for t in texts])
        opens = np.zeros(n + 1, bool)  # positions where a text begins (or the end)
        opens[0] = opens[ends] = True
        kind = self.classes[points]
        start = opens[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        # the last white space before other text stands alone, or leads that text when it is a plain blank
        last = space.copy()
        last[:-1] &= ~space[1:]
        last &= ~opens[1:]
        start |= last
        leads = np.flatnonzero(last & (points == 0x20))
        start[leads + 1] = False
        # apostrophe endings: the apostrophe must begin a word
        for q in np.flatnonzero((points == 0x27) & start).tolist():
            ending = next((e for e in ENDINGS if joined.startswith(e, q + 1)), None)
            if ending and not opens[q + 1 : q + 1 + len(ending)].any():
                start[q + 1] = False
                stop = q + 1 + len(ending)
                if stop < n:
                    start[stop] = True
        bounds = np.flatnonzero(start)
        counts = np.diff(np.searchsorted(bounds, ends), prepend=0)
        edges = bounds.tolist()
        edges.append(n)
        return [joined[a:b] for a, b in zip(edges, edges[1:])], counts

    def split_one(self, text: str) -> list[str | int]:
        """Words of a text with added tokens (as ids) or code points the class table does not know."""
        if self.slow is None:
            from tokenizers import pre_tokenizers

            self.slow = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        for token, number in self.added.items():
            if token in text:
                parts = [self.split_one(p) if p else [] for p in text.split(token)]
                out = parts[0]
                for part in parts[1:]:
                    out = [*out, number, *part]
                return out
        if not text:
            return []
        return [text[a:b] for _, (a, b) in self.slow.pre_tokenize_str(text)]

    def plain(self, text: str) -> bool:
        if any(t in text for t in self.added):
            return False
        return text.isascii() or not (self.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == UNKNOWN).any()

    # ---- encoding ------------------------------------------------------------------------------

    def boundary(self, left: int, right: int) -> bool:
        """True if two tokens side by side stay apart: undo their merges, latest first, and see that no merge
        across the boundary would have come earlier (equal ranks go left to right)."""
        limit = len(self.rank) + 1
        while True:
            across = self.rank.get(left * self.size + right)
            if across is not None and across < limit:
                return False
            a, b = self.born[left], self.born[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.right[left]
            else:
                limit, right = b + 1, self.left[right]

    def learn(self, words: set[str]) -> None:
        """Encode distinct words by walking their trie depth first."""
        ids, ends, survives, size = self.ids, self.ends, self.survives, self.size
        path: list[int] = []  # state of each node on the way to the current one
        widths: list[int] = []  # its token's length
        before = b""
        for word, text in sorted((w.encode(), w) for w in words):
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del path[depth:], widths[depth:]
            for stop in range(depth + 1, len(word) + 1):
                tail = word[stop - 3 : stop] if stop > 2 else word[:stop]
                widths_here = ends.get(tail)
                if widths_here is None:
                    widths_here = [2, 1] if stop > 1 and tail[-2:] in ids else [1]
                for width in widths_here:
                    if width > stop:
                        continue
                    token = ids.get(word[stop - width : stop])
                    if token is None:
                        continue
                    if width == stop:
                        break
                    key = path[stop - width - 1] * size + token
                    apart = survives.get(key)
                    if apart is None:
                        apart = survives[key] = self.boundary(path[stop - width - 1], token)
                    if apart:
                        break
                if width != widths_here[0]:  # what fitted last is tried first
                    widths_here.remove(width)
                    widths_here.insert(0, width)
                path.append(token)
                widths.append(width)
            tokens, stop = [], len(word)
            while stop:
                tokens.append(path[stop - 1])
                stop -= widths[stop - 1]
            tokens.reverse()
            self.words[text] = len(self.at) - 1
            self.flat.extend(tokens)
            self.at.append(len(self.flat))
            before = word
        if len(survives) > PAIRS_KEPT:
            survives.clear()

    def _encode_run(self, words: list, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct = set(words)
        new = distinct.difference(self.words)
        cost = sum(WORD_COST + (len(w) if isinstance(w, str) else 0) for w in new)
        if self.held + cost > MEMO_BYTES:
            self.forget()
            new = set(distinct)
        self.held += cost
        for number in [w for w in new if isinstance(w, int)]:
            new.discard(number)
            self.words[number] = len(self.at) - 1
            self.flat.append(number)
            self.at.append(len(self.flat))
        self.learn(new)
        which = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        at = np.frombuffer(self.at, np.int64)
        first, length = at[which], at[which + 1] - at[which]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(first - (ends - length), length) + np.arange(total)
        flat = np.frombuffer(self.flat, np.int32)[place] if total else np.zeros(0, np.int32)
        del at
        sizes = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])
        return flat, sizes

    def pieces(self, text: str) -> Iterator[str]:
        """A text cut where words end, so that a very long one is split into words piece by piece."""
        at = 0
        while len(text) - at > CHARS_AT_ONCE:
            cut = CUT.search(text, at + CHARS_AT_ONCE)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of a run of texts one after the other, number of ids of each text), run by run. Runs end after
        `CHARS_AT_ONCE` characters, a longer text is a run of its own."""
        run: list[str] = []
        chars = 0
        for text in texts:
            text = text or ""
            plain = self.plain(text)
            if run and (not plain or chars + len(text) > CHARS_AT_ONCE):
                yield self._encode_run(*self.split(run))
                run, chars = [], 0
            if not plain:
                words = self.split_one(text)
                yield self._encode_run(words, np.array([len(words)]))
            elif len(text) > CHARS_AT_ONCE:
                parts = [self._encode_run(*self.split([p]))[0] for p in self.pieces(text)]
                yield np.concatenate(parts), np.array([sum(map(len, parts))])
            else:
                run.append(text)
                chars += len(text)
        if run:
            yield self._encode_run(*self.split(run))


def values(column: pa.Array) -> Iterator:
    """The values of an Arrow column one by one, never as a list."""
    for value in column:
        yield value.as_py()


def id_lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.astype(np.int32, copy=False)))


def decoder(vocabulary: dict):
    """Function from ids to text; unknown ids hold no bytes."""
    table = {i: t for t, i in vocabulary["ids"].items()} | {i: t.encode() for t, i in vocabulary["added"].items()}
    return lambda ids: b"".join(map(table.get, ids, repeat(b""))).decode("utf-8", "replace")


def _encoded(docs: DataFrame, vocabulary: str, text_col: str, keep: Sequence[str], out: str, decoded: str | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    keep = list(keep)
    extra = [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)]
    if decoded is not None:
        extra.append(T.StructField(decoded, T.StringType(), False))
    schema = T.StructType([*[docs.schema[c] for c in keep], *extra])

    def task(batches):
        codec = Codec(shared.value)
        back = decoder(shared.value) if decoded is not None else None
        for batch in batches:
            row = 0
            for flat, sizes in codec.encode(values(batch.column(len(keep)))):
                columns = [c.slice(row, len(sizes)) for c in batch.columns[: len(keep)]]
                row += len(sizes)
                columns.append(id_lists(flat, sizes))
                if back:
                    edges = [0, *np.cumsum(sizes).tolist()]
                    columns.append(pa.array([back(flat[a:b].tolist()) for a, b in zip(edges, edges[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(*keep, text_col).mapInArrow(task, schema)


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), out: str = "token_ids") -> DataFrame:
    """`keep` columns and the token ids of every whole text. No shuffle: each task walks the trie of its texts, a
    bounded run of them at a time."""
    return _encoded(docs, vocabulary, text_col, keep, out, None)


def round_trip(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), out: tuple[str, str] = ("token_ids", "decoded")) -> DataFrame:
    """`keep` columns, the token ids of every whole text and the text those ids stand for, in one worker pass."""
    return _encoded(docs, vocabulary, text_col, keep, *out)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "token_ids", keep: Sequence[str] = ("doc_id",), out: str = "text") -> DataFrame:
    """`keep` columns and the text of every list of ids; a null list is an empty one."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    keep = list(keep)
    schema = T.StructType([*[encoded.schema[c] for c in keep], T.StructField(out, T.StringType(), False)])

    def task(batches):
        back = decoder(shared.value)
        for batch in batches:
            lists = batch.column(len(keep))
            edges, flat = lists.offsets.to_pylist(), lists.values
            row, texts, held = 0, [], 0
            for a, b in zip(edges, edges[1:]):
                texts.append(back(flat.slice(a, b - a).to_numpy(zero_copy_only=False).tolist()))
                held += b - a
                if held > IDS_AT_ONCE or row + len(texts) == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*[c.slice(row, len(texts)) for c in batch.columns[: len(keep)]], pa.array(texts, pa.string())], schema.names)
                    row, texts, held = row + len(texts), [], 0

    return encoded.select(*keep, ids_col).mapInArrow(task, schema)
