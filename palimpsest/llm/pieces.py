"""SentencePiece encoding and decoding of a model of the merge (BPE) type, exactly as the library does it.

The library merges adjacent symbols, best score first, over a whole text. Here the same result is found from left to right: at
each place the longest piece (all pieces that start there come from one Aho-Corasick pass) that may follow its neighbour. Two
adjacent pieces are compatible if merging their characters anew would keep the border between them; a bitfield marks the places
from which no way on was found, and the search steps back to a shorter piece.

A text is cut first where no piece can cross: before a blank that follows another character, and around characters that
no piece holds (these become bytes). What is between two cuts is encoded alone and kept in a bounded cache.

Nulls count as empty; an empty text has no pieces (only the end id, if asked for). Texts may be of any length: without blanks they
are one stretch, searched in one pass. Literal U+2581 is a blank to the library and so decodes as one. Ties and repeated
rows give equal results; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BLANK = "▁"
#: Stretches that a worker's cache holds, and the longest that goes into it (characters).
CACHE, CACHE_CHARS = 400_000, 40


class Model:
    """Pieces of a model file. ``encode`` and ``decode`` work on lists of ids."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.eos, self.unknown = sp.eos_id(), sp.unk_id()
        self.surface: list[bytes] = []
        piece: dict[str, tuple[float, int]] = {}
        byte = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte[int(p[3:5], 16)] = i
                self.surface.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i):
                self.surface.append(b"")
            elif sp.is_unknown(i):
                self.surface.append(b" \xe2\x81\x87 ")
            else:
                piece[p] = (sp.get_score(i), i)
                self.surface.append(p.replace(BLANK, " ").encode())
        if len(byte) != 256:
            raise ValueError("a model with byte fallback is needed")
        if any(BLANK in p.lstrip(BLANK) for p in piece):
            raise ValueError("a piece of this model crosses words")
        self.byte = [byte[b] for b in range(256)]
        self.id = {p: i for p, (_, i) in piece.items()}
        # a rank is a piece's place in the order of merges; single characters come first, as they are no merge
        self.rank = {p: (-1e18 if len(p) == 1 else -s) for p, (s, _) in piece.items()}
        self.chars = {p for p in piece if len(p) == 1}
        self.compatible = lru_cache(maxsize=1 << 18)(self._compatible)
        #: for a piece and the longest match behind it, what may follow; bounded by the pairs of pieces that texts hold
        self.after: dict[str, dict[str, str]] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        for p in sorted(piece, key=lambda p: (len(p), p)):
            self.halves[p] = self._halve(p)
        self.find = ahocorasick.Automaton()
        for p, h in self.halves.items():
            if len(p) == 1 or h:
                self.find.add_word(p, p)
        self.find.make_automaton()
        #: for each piece the longest other piece that it begins with
        self.shorter = {p: next((q for k in range(len(p) - 1, 0, -1) if (q := p[:k]) in self.find), "") for p in self.halves}
        self.decimal = [str(i) for i in range(n)]
        other = "".join(re.escape(c) for c in sorted(self.chars) if c != BLANK)
        self.stretch = re.compile(f"{BLANK}*[{other}]+|{BLANK}+|[^{BLANK}{other}]+")
        # a model may also normalise texts or drop blanks, which is not done here
        for probe in ("  a  b ", "ﬁ ① Ａ e\u0301", "\t x\n", ""):
            if self.encode(probe) != sp.encode(probe):
                raise ValueError("this model changes texts before it encodes them")

    def _halve(self, p: str) -> tuple[str, str] | None:
        """The last merge that makes p of its characters; None if they are merged to something else."""
        parts = list(p)
        if len(parts) == 1:
            return None
        if any(c not in self.chars for c in parts):
            return None
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _compatible(self, left: str, right: str) -> bool:
        """Whether merging left + right anew keeps the border: no merge across it comes before those that make the two.

        Going back in the order of merges, the later made of the two is undone to its half at the border, and the pair of
        halves must not have merged before the piece just undone was made. Of equal ranks the left one is merged first.
        """
        limit = float("inf")
        first = False  # whether a merge at the limit itself comes before what was undone
        while True:
            r = self.rank.get(left + right)
            if r is not None and (r < limit or first and r == limit):
                return False
            a, b = (self.rank[left] if len(left) > 1 else None), (self.rank[right] if len(right) > 1 else None)
            if a is None and b is None:
                return True
            if b is None or a is not None and a > b:
                limit, first, left = a, False, self.halves[left][1]
            else:
                limit, first, right = b, True, self.halves[right][0]

    def _after(self, last: str, p: str) -> str:
        """p or the longest piece that p begins with and that may follow last (any, if last is empty); empty if there is none."""
        while p and last and not self.compatible(last, p):
            p = self.shorter[p]
        return p

    def longest(self, text: str) -> list[str]:
        """The longest piece at each place of a text, from one pass over all its matches."""
        out = [""] * len(text)
        for end, p in self.find.iter(text):
            if len(p) > len(out[at := end - len(p) + 1]):
                out[at] = p
        return out

    def pieces(self, text: str) -> list[str]:
        """The pieces of a stretch of known characters."""
        n = len(text)
        find, after = self.find.iter_long, self.after
        if n <= 64:  # as below, without the bitfield: no step back is needed as a rule
            out, at, last, longest = [], 0, "", find(text)
            while at < n:
                _, p = next(longest)
                key = after.get(last)
                if key is None:
                    key = after[last] = {}
                q = key.get(p)
                if q is None:
                    q = key[p] = self._after(last, p)
                if not q:
                    break
                out.append(q)
                at += len(q)
                last = q
                if q is not p:
                    longest = find(text, at)
            else:
                return out
        table = self.longest(text) if n > 64 else None
        shorter, compatible = self.shorter, self.compatible
        out: list[str] = []
        failed = at = 0
        last = None
        p = table[0] if table else next(find(text))[1]
        while True:
            while p and (failed >> at + len(p) & 1 or last is not None and not compatible(last, p)):
                p = shorter[p]
            if p:
                out.append(p)
                last = p
                at += len(p)
                if at == n:
                    return out
                p = table[at] if table else next(find(text, at))[1]
            else:
                failed |= 1 << at
                if not out:
                    raise ValueError(f"no way to write {text[:80]!r}")
                p = out.pop()
                at -= len(p)
                p, last = shorter[p], out[-1] if out else None

    def ids(self, stretch: str) -> list[int]:
        if stretch[-1] not in self.chars:
            return [self.byte[b] for b in stretch.encode()]
        return [self.id[p] for p in self.pieces(stretch)]

    def stretches(self, text: str) -> list[str]:
        """What can be encoded alone, in order; the library puts a blank before a text."""
        return self.stretch.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def encode(self, text: str, end: bool = False) -> list[int]:
        return [i for s in self.stretches(text) for i in self.ids(s)] + [self.eos] * end

    def joined(self, ids: list[int]) -> bytes:
        return b"".join([self.surface[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; the blank before a text goes."""
        return self.joined(ids).removeprefix(b" ").decode("utf-8", "replace")


_models: dict[str, Model] = {}
_kept: dict[str, list[dict[str, tuple[str, bytes]]]] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


class Digest:
    """Encodes whole texts with a cache: the ids as decimals and the decoded text.

    The cache has two generations of at most CACHE stretches: what is used of the old one moves to the new one. It holds for each
    stretch the decimals of its ids and the bytes that those ids are decoded to; pieces of bytes never cross a stretch.
    """

    def __init__(self, path: str):
        self.model = model(path)
        self.new, self.old = _kept.setdefault(path, [{}, {}])  # stretch: (decimals, bytes)
        #: what lets a text be cut by split() alone
        self.plain = self.model.chars - {BLANK} | {" ", "\n"}

    def of(self, stretch: str) -> tuple[str, bytes]:
        got = self.old.get(stretch)
        if got is None:
            decimal, ids = self.model.decimal, self.model.ids(stretch)
            got = " ".join([decimal[i] for i in ids]), self.model.joined(ids)
        if len(stretch) <= CACHE_CHARS:
            if len(self.new) >= CACHE:
                self.old.clear()
                self.old.update(self.new)
                self.new.clear()
            self.new[stretch] = got
        return got

    def stretches(self, text: str) -> list[str]:
        if "  " in text or text.startswith(" ") or not self.plain.issuperset(text):
            return self.model.stretches(text)
        if not text:
            return []
        out: list[str] = []
        for i, line in enumerate(text.replace(" ", f" {BLANK}").split("\n")):
            words = line.split(" ")
            if not i:
                words[0] = BLANK + words[0]
            else:
                out.append("\n")
                if not words[0]:
                    del words[0]
            out += words
        return out

    def __call__(self, text: str) -> tuple[str, bytes]:
        """The ids as decimals and the UTF-8 bytes of what they are decoded to."""
        got = list(map(self.new.get, words := self.stretches(text)))
        if None in got:
            got = [d or self.of(w) for d, w in zip(got, words, strict=True)]
        end = self.model.decimal[self.model.eos]
        if not got:
            return end, b""
        ids, parts = zip(*got, strict=True)
        return f"{' '.join(ids)} {end}", b"".join(parts).removeprefix(b" ")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ids (array of int, end id last) and decoded (what the library's decode gives for them)."""
    docs = docs.drop("ids", "decoded")
    schema = docs.selectExpr("*", "cast(null as array<int>) ids", "cast(null as string) decoded").schema

    def part(batches):
        m = model(path)
        for b in batches:
            ids = [m.encode(t or "", True) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([m.decode(x) for x in ids], pa.string())], [*b.schema.names, "ids", "decoded"])

    return docs.mapInArrow(part, schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of what encode() gives, without carrying it along."""

    def part(batches):
        of = Digest(path)
        gc.disable()  # the cache holds many small objects and no cycles
        try:
            for b in batches:
                n, ids, text = [], [], []
                for t in b.column(1):
                    d, back = of(t.as_py() or "")
                    n.append(d.count(" ") + 1)
                    ids.append(hashlib.sha256(d.encode()).hexdigest())
                    text.append(hashlib.sha256(back).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            gc.enable()

    return docs.select("doc_id", "text").mapInArrow(part, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
