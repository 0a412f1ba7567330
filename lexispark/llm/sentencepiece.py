"""SentencePiece encoding and decoding by a streaming Viterbi.

The lattice has a node at every character boundary and an edge for every piece of the vocabulary that fits
(characters without a piece become byte pieces). Each node keeps one backpointer: the last piece of the best
segmentation of the text up to it. An edge can only start at most the longest piece before it ends, so a
window of that length is retained. Whenever it is full and the backpointer paths of all nodes in it meet in one
boundary, the ids before that are final and committed.

For a unigram model the best path has the largest sum of scores. A model of the BPE type orders its merges
by score instead: its segmentation is the only one in which every two neighbours stay apart when their text
is merged on its own. So a path may be extended by a piece if the piece and the path's last piece are such
neighbours, and exactly one edge into each node qualifies. Both kinds run through the same window.

No piece of most models reaches over the start of a word mark that follows another character. There a single node survives, all
paths converge, and the window starts empty: what is committed for the stretch up to the next such boundary
hangs on that stretch alone. So the stretches of some texts go through the window together, those with
equal beginnings sharing their nodes (lattice.py), and a bounded memo keeps the ids of each.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.worker import once

from .common import tucked, untucked
from .lattice import Lattices

MARK = "▁"
BPE = 2
#: Characters of text whose stretches go through the window together.
CHARACTERS = 1_000_000
#: The longest stretch of which the ids are remembered beyond that.
KEPT = 64
#: Texts that are Python objects at a time.
SLICE = 250


class Codec:
    """Encoder and decoder of one model file. cache: the number of stretches, and half of the number of pairs of pieces, beyond which what
    is known of them is forgotten."""

    def __init__(self, content: bytes, cache: int = 200_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=content)
        self.bpe, self.prefix = kind(content)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.codes = {p: array("i", [i]).tobytes() for p, i in self.ids.items()}
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.order = {p: -s for p, s in self.score.items() if len(p) > 1}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = model.unk_id()
        self.byte_of = {i: b for b, i in enumerate(self.bytes) if model.is_byte(i)}
        #: Bytes from 0x80 on have to be put together; others are characters.
        self.high = np.array([self.byte_of.get(i, 0) > 127 for i in range(n)])
        self.strings = [chr(self.byte_of[i]) if i in self.byte_of else p for i, p in enumerate(self.pieces)]
        self.longest = max(map(len, self.ids), default=1)
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        #: Stretches that no piece leaves: a run of marks with what follows it up to the next mark. Else whole texts.
        self.stretches = None if inner else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        #: Characters that are in no piece are stretches of their own.
        self.runs = re.compile((lambda known: f"[{known}]+|[^{known}]")("".join(map(re.escape, sorted(set().union(*self.ids))))), re.DOTALL)
        self.pairs, self.n_pairs = {}, 0
        self.merged: dict[str, tuple[str, str]] = {}  # of pieces of the vocabulary only
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.lattices: Lattices | None = None
        self.cache = cache

    def parts(self, piece: str) -> tuple[str, str]:
        """The two parts of which merging makes a piece last; best score first, then leftmost."""
        if piece not in self.merged:
            parts = list(piece)
            while len(parts) > 2:
                k = min(range(len(parts) - 1), key=lambda i: (self.order.get(parts[i] + parts[i + 1], np.inf), i))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.merged[piece] = (parts[0], parts[1])
        return self.merged[piece]

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether merging the text a + b on its own gives a, b: no merge over the boundary may be due before
        the merges that make a and b. These are undone from the last to the first; at each step the parts at
        the boundary must not merge before the merge just undone. Of two equal merges the left one is due first."""
        order, left, right, due = self.order, a, b, np.inf
        while True:
            over = order.get(left + right)
            if over is not None and over < due:
                return False
            made_left = order[left] if len(left) > 1 else -1.0
            made_right = order[right] if len(right) > 1 else -1.0
            if made_left == made_right == -1.0:
                return True
            if made_left > made_right:
                left, due = self.parts(left)[1], made_left
            else:
                right, due = self.parts(right)[0], made_right + 0.5

    def edge(self, text: str, at: int, back: list, base: int) -> tuple[str, float]:
        """The last piece of the best path to boundary `at`, and the path's score (0 for BPE)."""
        if not self.bpe:
            ids, score, best = self.ids, self.score, ("", -np.inf)
            for start in range(at - 1, max(base, at - self.longest) - 1, -1):
                piece = text[start:at]
                if piece in ids or start == at - 1:
                    total = back[start - base][1] + score.get(piece, -1e6)
                    if total > best[1] or total == best[1] and len(piece) > len(best[0]):
                        best = (piece, total)
            return best
        # One edge qualifies; that which makes the last piece one character longer is the likeliest.
        start, tried = at - 1 - len(back[at - 1 - base][0]), -1
        if start >= base:
            piece = text[start:at]
            if piece in self.ids:
                tried, last = start, back[start - base][0]
                if not last:
                    return piece, 0.0
                apart = self.pairs[last].get(piece) if last in self.pairs else None
                if apart or apart is None and self.apart(last, piece):
                    return piece, 0.0
        return self.other_edge(text, at, back, base, tried)

    def other_edge(self, text: str, at: int, back: list, base: int, but: int) -> tuple[str, float]:
        """The edge that qualifies in a BPE lattice, shorter pieces first; none starts at `but`."""
        ids, pairs = self.ids, self.pairs
        for start in range(at - 1, max(base, at - self.longest) - 1, -1):
            piece = text[start:at]
            if start != but and (piece in ids or start == at - 1):
                last = back[start - base][0]
                if not last:
                    return piece, 0.0
                apart = pairs[last].get(piece) if last in pairs else None
                if apart or apart is None and self.apart(last, piece):
                    return piece, 0.0
        raise ValueError(f"no path to {text[base:at]!r}")

    def apart(self, a: str, b: str) -> bool:
        after = self.pairs.get(a)
        if after is None:
            after = self.pairs[a] = {}
        known = after.get(b)
        if known is None:
            self.n_pairs += 1
            if self.n_pairs > 2 * self.cache:
                self.pairs, self.n_pairs = {}, 0
            known = after[b] = self.stay_apart(a, b)
        return known

    def stream(self, text: str):
        """Yields committed runs of pieces of a stretch."""
        far, edge, end = self.longest, self.edge, len(text)
        back, base = [("", 0.0)], 0
        for at in range(1, end + 1):
            back.append(edge(text, at, back, base))
            if at - base > far and at < end:
                meet = self.meeting(back, base, at)
                if meet > base:
                    yield self.path(back, meet - base)
                    back, base = back[meet - base :], meet
        yield self.path(back, end - base)

    def meeting(self, back: list, base: int, at: int) -> int:
        """The last boundary that the paths of all nodes within the longest piece of `at` share."""
        open_ = set(range(max(base, at - self.longest + 1), at + 1))
        while len(open_) > 1:
            p = max(open_)
            open_.remove(p)
            open_.add(p - len(back[p - base][0]) if p > base else base)
        return open_.pop()

    @staticmethod
    def path(back: list, at: int) -> list[str]:
        """The pieces of the path to back[at]."""
        run = []
        while at > 0:
            piece = back[at][0]
            run.append(piece)
            at -= len(piece)
        run.reverse()
        return run

    def together(self, stretches) -> dict[str, bytes]:
        """The ids of those stretches that fit into one window, of which nothing is committed before the end; only for models of the
        BPE type and characters that are pieces."""
        some = sorted(x for x in stretches if len(x) <= self.longest) if self.bpe else []
        if not some:
            return {}
        if self.lattices is None:
            self.lattices = Lattices([p if i == self.ids.get(p) else None for i, p in enumerate(self.pieces)], lambda a, b: self.stay_apart(self.pieces[a], self.pieces[b]), 2 * self.cache)
        known, ids, counts = self.lattices.encode(some)
        content, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        return {x: content[a:b] for x, good, a, b in zip(some, known.tolist(), [0, *ends], ends, strict=False) if good}

    def committed(self, keys) -> dict[str, bytes]:
        """The ids of stretches. Those that fit into a window go through it together. The others fall apart at characters that are in
        no piece; what of them is still longer than the window goes through it on its own."""
        texts = {key: self.whole(key) for key in keys}
        done = self.together(texts.values())
        apart = {x: self.runs.findall(x) for x in texts.values() if x not in done}
        parts = set().union(*apart.values()).difference(done)
        done |= self.together(parts)
        for x in parts:
            if x not in done:
                done[x] = b"".join(map(self.numbered, self.stream(x)))
        for x, runs in apart.items():
            done[x] = b"".join([done[r] for r in runs])
        return {key: done[x] for key, x in texts.items()}

    def keys(self, text: str) -> list[str]:
        """The stretches of a text; the one mark at the begin of a stretch is left out where every text begins with a mark."""
        if not self.stretches:
            return [(MARK if self.prefix else "") + text.replace(" ", MARK)]
        if not self.prefix:
            return self.stretches.findall(text.replace(" ", MARK))
        if text[0] != " " != text[-1] and "  " not in text and MARK not in text:
            return text.split(" ")
        return [x[1:] if x[1:2] not in ("", MARK) else x for x in self.stretches.findall(MARK + text.replace(" ", MARK))]

    def whole(self, key: str) -> str:
        return MARK + key if self.prefix and self.stretches and key[0] != MARK else key

    def numbered(self, pieces: list[str]) -> bytes:
        """The ids of pieces, 4 bytes each; those that are not in the vocabulary are single characters."""
        codes = self.codes
        try:
            return b"".join([codes[p] for p in pieces])
        except KeyError:
            for p in set(pieces).difference(codes):
                own = [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")] if self.byte_of else [self.unknown]
                codes[p] = array("i", own).tobytes()
            return b"".join([codes[p] for p in pieces])

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; none for null and empty texts."""
        return self.encode_all([text])[0]

    def encode_all(self, texts) -> list[np.ndarray]:
        """The ids of texts, CHARACTERS at a time; their stretches are looked up together."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= CHARACTERS:
                out += self.encode_some(held)
                held, size = [], 0
        return out + self.encode_some(held)

    def encode_some(self, texts) -> list[np.ndarray]:
        lists = [self.keys(t) if t else [] for t in texts]
        if len(self.known) > self.cache // 2:  # what has not been met since the last time goes
            self.old, self.known = self.known, {}
        known, used = self.known, set().union(*lists)
        known.update((x, self.old[x]) for x in used.intersection(self.old) if x not in known)
        new = used.difference(known)
        known.update(self.committed(new))
        out = [np.frombuffer(b"".join([known[x] for x in own]), np.int32) for own in lists]
        if not self.byte_of:  # unknown characters in a row have one id
            out = [x[np.concatenate(([True], (x[1:] != self.unknown) | (x[:-1] != self.unknown)))[: len(x)]] for x in out]
        for x in new:
            if len(x) > KEPT:
                del known[x]
        return out

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are put together, marks become blanks, and the one that encoding puts
        before a text goes. Bytes that are not UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        if self.high[ids].any():
            out, held = [], bytearray()
            for i in ids.tolist():
                if i in self.byte_of:
                    held.append(self.byte_of[i])
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held = bytearray()
                out.append(self.pieces[i])
            text = "".join(out) + held.decode("utf-8", "replace")
        else:
            text = "".join(map(self.strings.__getitem__, ids.tolist()))
        return (text[1:] if self.prefix and text.startswith(MARK) else text).replace(MARK, " ")


def kind(content: bytes) -> tuple[bool, bool]:
    """Whether a model is of the BPE type and whether it puts a mark before texts. Models that change the text
    in other ways (rules of normalization, removal of blanks) are refused."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(content)
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("the model normalizes texts")
    if model.trainer_spec.model_type not in (1, BPE):
        raise ValueError("the model is neither unigram nor BPE")
    return model.trainer_spec.model_type == BPE, spec.add_dummy_prefix


def codec(content: bytes) -> Codec:
    """Made once per worker and model."""
    return once(("codec", content), lambda: Codec(content))


def read_model(spark, path: str) -> bytes:
    """The bytes of a model file: a plain path is read by the driver, others through Spark."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def in_slices(texts, model: bytes, check: bool):
    """The ids of an Arrow array of texts as an Arrow list array and, with check, whether each text comes back.
    A few hundred texts at a time become Python objects."""
    import pyarrow as pa

    c, parts, lengths, same = codec(model), [np.empty(0, np.int32)], [0], []
    for at in range(0, len(texts), SLICE):
        some = texts.slice(at, SLICE).to_pylist()
        ids = c.encode_all(some)
        lengths += map(len, ids)
        parts.append(np.concatenate(ids))
        if check:
            same += [c.decode(i) == (t or "").replace(MARK, " ") for t, i in zip(some, ids, strict=True)]
    offsets = np.cumsum(np.array(lengths, np.int64)).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(parts)), pa.array(same, pa.bool_())


def encode(docs: DataFrame, model: bytes, text_col: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array of ids of the whole text; none for null and empty texts, null for neither. Repeated
    rows are encoded each; an empty table gives no rows. A column of the name `ids` is replaced."""

    @F.arrow_udf("array<int>")
    def encoded(texts):
        return in_slices(texts, model, False)[0]

    return docs.withColumn(ids, encoded(F.col(text_col)))


def encode_checked(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """docs with ids and round_trip: whether decoding them gives the text again (literal word marks as blanks).
    Columns of these names are replaced; otherwise as encode."""

    @F.arrow_udf("struct<ids:array<int>,round_trip:boolean>")
    def encoded(texts):
        import pyarrow as pa

        return pa.StructArray.from_arrays(in_slices(texts, model, True), ["ids", "round_trip"])

    made = tucked(docs, text=text_col).withColumn("both", encoded(F.col("text")))
    own = [c for c in docs.columns if c not in ("ids", "round_trip")]
    return made.select(*untucked(own, text=text_col), "both.ids", "both.round_trip")


def decode(rows: DataFrame, model: bytes, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text of their ids; empty for null and for no ids."""

    @F.arrow_udf("string")
    def decoded(lists):
        import pyarrow as pa

        c, out = codec(model), []
        for at in range(0, len(lists), SLICE):
            out += [c.decode(x) if x else "" for x in lists.slice(at, SLICE).to_pylist()]
        return pa.array(out, pa.string())

    return rows.withColumn(text, decoded(F.col(ids)))
