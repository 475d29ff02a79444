"""SentencePiece BPE encoding by a table of last tokens, and decoding.

The last token of the encoding of each prefix of a text is unique. For each prefix the tokens that end it come from
an Aho-Corasick automaton; the one whose pair with the last token of the shorter prefix re-encodes to itself is
stored. Ids follow by walking back from the end. Texts fall apart between any two characters that no piece has side by
side: before word marks and around runs of signs. Parts are remembered, so a frequent one is worked out once per worker.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Parts (in each of two generations) and pairs that a worker remembers; beyond that it forgets the oldest, which costs time and no result.
PARTS, PAIRS = 150_000, 300_000
#: Longer parts aren't remembered.
PART_CHARS = 64


class Parts(dict):
    """What is known of a part; a full generation becomes the old one, whose parts come back on use."""

    def __init__(self, learn: Callable[[str], tuple[str, bytes, bytes]]) -> None:
        super().__init__()
        self.learn = learn
        self.old: dict[str, tuple[str, bytes, bytes]] = {}

    def __missing__(self, part: str) -> tuple[str, bytes, bytes]:
        found = self.old.get(part) or self.learn(part)
        if len(part) <= PART_CHARS:
            if len(self) >= PARTS:
                self.old = dict(self)
                self.clear()
            self[part] = found
        return found


def part_patterns(pieces: Iterable[str]) -> tuple[re.Pattern[str], re.Pattern[str]]:
    """Cuts of a marked text and of its parts, all between characters that no piece has side by side, so that no merge crosses one.

    A text is cut before its runs of marks. A part is cut into runs of signs or of other characters behind their marks;
    a sign that some piece has before another character takes that run along.
    """
    beside = {pair for p in pieces for pair in zip(p, p[1:], strict=False)}
    if any(b == MARK != a for a, b in beside):
        return re.compile("(?s).+"), re.compile("(?s).+")
    signs = {c for p in pieces for c in p if not c.isalpha() and c != MARK} | set("\n\t\r")
    while glued := {b for a, b in beside if b in signs and a not in signs and a != MARK}:
        signs -= glued
    tied = {a for a, b in beside if a in signs and b not in signs}
    inside = lambda cs: "".join(map(re.escape, sorted(cs)))
    other, sign = f"[^{MARK}{inside(signs)}]+", f"[{inside(signs)}]+"
    tail = f"(?:(?<=[{inside(tied)}]){other})?" if tied else ""
    return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+"), re.compile(f"{MARK}*{other}|{MARK}*{sign}{tail}|{MARK}+")


class PrefixTable:
    """Encoder and decoder for one BPE model file."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only BPE models with identity normalisation and a dummy prefix are supported")
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.raw: list[bytes] = []
        octets: dict[int, int] = {}
        self.unk = 0
        for i, p in enumerate(model.pieces):
            self.raw.append(p.piece.replace(MARK, " ").encode() if p.type in (1, 4, 5) else b"")
            if p.type in (1, 4, 5):
                self.score[p.piece] = p.score
                self.ids[p.piece] = i
            elif p.type == 6:
                octets[int(p.piece[3:5], 16)] = i
                self.raw[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 2:
                self.unk = i
                self.raw[i] = model.trainer_spec.unk_surface.encode()
        self.octets = octets if model.trainer_spec.byte_fallback else {}
        self.parts, self.runs = part_patterns(list(self.score))
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.histories: dict[str, list[tuple[float, str, str]] | None] = {}
        self.known, self.known_tokens = Parts(self.learn), Parts(self.learn_token)

    def merges(self, token: str) -> list[tuple[float, str, str]] | None:
        """The library's merges on a token alone: best score first, leftmost among equals. Each with its score and the first and last part after it; None if they don't end in the token."""
        parts, score, out = list(token), self.score, []
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                x = score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out.append((best, parts[0], parts[-1]))
        return out

    def history(self, token: str) -> list[tuple[float, str, str]] | None:
        if token not in self.score:
            return self.merges(token)
        if token not in self.histories:
            self.histories[token] = self.merges(token)
        return self.histories[token]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the merges of left + right end in these two: both go their own way as long as no merge across the middle comes first."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[left, right] = self.apart(left, right)
        return found

    def apart(self, left: str, right: str) -> bool:
        a, b = self.history(left) if left else [], self.history(right)
        if a is None or b is None:
            return False
        if not left:
            return True
        none = float("-inf")
        i, j, x, y = 0, 0, left[-1], right[0]
        across = self.score.get(x + y, none)
        while True:
            p = a[i][0] if i < len(a) else none
            q = b[j][0] if j < len(b) else none
            if across > p and across >= q and across > none:
                return False
            if p == q == none:
                return True
            if p >= q:
                z = (a[i][2], y)
                i += 1
            else:
                z = (x, b[j][1])
                j += 1
            if z != (x, y):
                x, y = z
                across = self.score.get(x + y, none)

    def tokens(self, part: str) -> list[str]:
        """The pieces of one part, by the table of last tokens."""
        last = ["", *part]  # characters that end no piece stand alone
        pairs, known = self.pairs, 0
        for end, piece in self.automaton.iter(part):
            if end < known:
                continue
            left = last[end + 1 - len(piece)]
            fits = pairs.get((left, piece))
            if fits is None:
                fits = self.compatible(left, piece)
            if fits:
                last[end + 1] = piece
                known = end + 1
        out, n = [], len(part)
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def learn(self, part: str) -> tuple[str, bytes, bytes]:
        """Ids of a part with commas, its decoded bytes, and its ids as 32-bit integers."""
        runs = [part] if part[1:].isalpha() else self.runs.findall(part)
        if len(runs) == 1:
            found = map(self.known_tokens.__getitem__, self.tokens(part))
        else:
            found = map(self.known.__getitem__, runs)
        csv, raw, ids = zip(*found, strict=True)
        return ",".join(csv), b"".join(raw), b"".join(ids)

    def learn_token(self, token: str) -> tuple[str, bytes, bytes]:
        """A piece's own id; ids of the bytes or the unknown id for a character without one."""
        if token in self.ids:
            ids = [self.ids[token]]
        elif self.octets:
            ids = [self.octets[x] for x in token.encode()]
        else:
            ids = [self.unk]
        return ",".join(map(str, ids)), b"".join([self.raw[i] for i in ids]), array("i", ids).tobytes()

    def split(self, text: str) -> list[tuple[str, bytes, bytes]]:
        if not text:
            return []
        return list(map(self.known.__getitem__, self.parts.findall(MARK + text.replace(" ", MARK))))

    def encode(self, text: str) -> list[int]:
        return array("i", b"".join([p[2] for p in self.split(text)])).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return self.text(b"".join(map(self.raw.__getitem__, ids)))

    @staticmethod
    def text(raw: bytes) -> str:
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def table(model_file: str) -> PrefixTable:
    return PrefixTable(model_file)


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for every row; whole texts, null counts as empty.

    Rows are independent: repeated rows each get their result, an empty table gives an empty one, other columns
    aren't read. `model_file` must be readable on the executors.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, sha = table(model_file), hashlib.sha256
        for b in batches:
            out: list[tuple] = []
            for text in b.column("_t"):
                parts = t.split(text.as_py() or "")
                told = ",".join([p[0] for p in parts])
                back = t.text(b"".join([p[1] for p in parts]))
                ids = np.frombuffer(b"".join([p[2] for p in parts]), np.int32) if with_ids else None
                out.append((told.count(",") + bool(told), sha(told.encode()).hexdigest(), sha(back.encode()).hexdigest(), ids, back if with_ids else None))
            kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
            kinds += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays([b.column(id_col)] + [pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(kinds)], names=[id_col] + [n for n, _ in kinds])

    src = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_t"))
    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return src.mapInArrow(run, schema)
