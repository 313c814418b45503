"""SentencePiece encoding and decoding with the byte span of every piece.

The text is normalised by the longest prefix found in the model's compiled character map; each normalised byte remembers the
source byte it came from. Pair merges then run on short units of the normalised text (no piece of the model reaches over a unit's
edge, which is checked when the model is read), and the ends of the pieces are projected through the alignment.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from itertools import pairwise
from operator import concat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words kept with their ids, per task.
CACHE = 200_000
#: Symbols up to which merging scans a list; a longer unit uses a heap.
SHORT = 48
#: New units from which they are merged side by side, in a table for each of these numbers of characters; longer ones are cut first.
TOGETHER, WIDTHS = 64, (7, 10, 14, 20, 32)
NONE = float("-inf")


def load_model(path: str) -> dict:
    """The model file as plain values, small enough to travel with a task. Only pair-merge models without user-defined symbols are read."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    return model_values(m)


def model_values(m: object) -> dict:
    if m.trainer_spec.model_type != 2 or any(p.type == USER for p in m.pieces):
        raise ValueError("a pair-merge (BPE) model without user-defined symbols is needed")
    if m.trainer_spec.treat_whitespace_as_suffix or not m.normalizer_spec.escape_whitespaces:
        raise ValueError("spaces must be escaped as prefixes of words")
    n = m.normalizer_spec
    return {
        "pieces": [p.piece for p in m.pieces], "scores": [p.score for p in m.pieces], "types": [p.type for p in m.pieces],
        "charsmap": bytes(n.precompiled_charsmap), "prefix": n.add_dummy_prefix, "squeeze": n.remove_extra_whitespaces,
        "bytes": m.trainer_spec.byte_fallback, "eos": m.trainer_spec.eos_id, "unk_surface": m.trainer_spec.unk_surface,
    }


class CharMap:
    """The compiled character map: a double array of UTF-8 bytes, then zero-terminated replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest key that starts at ``at`` (0: none), and its replacement."""
        units, best = self.units, (0, b"")
        if not units:
            return best
        node = _offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            has_leaf = units[node] >> 8 & 1
            node ^= _offset(units[node])
            if has_leaf:
                start = units[node] & 0x7FFFFFFF
                best = (k - at + 1, self.texts[start : self.texts.index(b"\0", start)])
        return best


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class Codec:
    def __init__(self, model: dict):
        self.m = model
        #: spaces are escaped, one is put in front, all else stays
        self.alike = not model["charsmap"] and not model["squeeze"] and model["prefix"]
        pieces, types = model["pieces"], model["types"]
        self.map = CharMap(model["charsmap"])
        self.score = {p: s for p, s, t in zip(pieces, model["scores"], types, strict=True) if t in (NORMAL, UNUSED)}
        self.id = {p: i for i, p in enumerate(pieces)}
        self.unused = {p for p, t in zip(pieces, types, strict=True) if t == UNUSED}
        self.unk = types.index(UNKNOWN)
        self.byte = [self.id.get(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [self._raw(p, t) for p, t in zip(pieces, types, strict=True)]
        self.characters = [len(p) for p in pieces]
        self.decimal = [str(i) for i in range(len(pieces))]
        # bytes of each piece in the normalised text, and in the source where a space is one byte
        self.width = np.array([1 if t == BYTE else len(p.encode()) if t in (NORMAL, UNUSED) else 0 for p, t in zip(pieces, types, strict=True)])
        self.source_width = np.array([1 if t == BYTE else len(p.replace(SPACE, " ").encode()) if t in (NORMAL, UNUSED) else 0 for p, t in zip(pieces, types, strict=True)])
        long = [p for p in self.score if len(p) > 1]
        self.apart = apart = not any(SPACE in p.lstrip(SPACE) for p in long)
        self.beside = {p[i : i + 2] for p in long for i in range(len(p) - 1)}
        self.units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if apart else re.compile("(?s).+")
        self.plain = {p: i for p, i in self.id.items() if p in self.score}
        self.pair_keys, self.pair_made, self.pair_scores = self._pairs(long)
        #: symbol of each character: the id of its piece; -2 if no piece holds it; -1 if one does, but it is none itself
        self.symbol = np.full(0x110000, -2, np.int32)
        for c in {c for p in long for c in p}:
            self.symbol[ord(c)] = -1
        for p, i in self.plain.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        #: packed ids: of the words of texts with single spaces, of other units
        self.cache: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}

    def _pairs(self, long: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours that merge, as left id * pieces + right id in order, with the id and the score of what they make; scores grow with 1 and more, 0 is none."""
        plain, n = self.plain, len(self.raw)
        halves = [(a * n + b, plain[p], self.score[p]) for p in long for i in range(1, len(p)) if (a := plain.get(p[:i])) is not None and (b := plain.get(p[i:])) is not None]
        key, made = (np.array([h[k] for h in halves], np.int64) for k in (0, 1))
        ranks = np.unique(np.array([h[2] for h in halves], float), return_inverse=True)[1].astype(np.int32) + 1
        at = np.argsort(key)
        # a last key that no pair has, so that every place that is looked up exists
        return np.append(key[at], np.iinfo(np.int64).max), np.append(made[at], 0), np.append(ranks[at], 0).astype(np.int32)

    def _raw(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind in (CONTROL, UNKNOWN):
            return b"" if kind == CONTROL else self.m["unk_surface"].encode()
        return piece.replace(SPACE, " ").encode()

    # normalisation -------------------------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text and, for each of its bytes and its end, the source byte.

        None as alignment: a space is one byte in the source and three in the text, the first space is added, all else is alike.
        """
        if not text:
            return "", np.zeros(1, np.int64)
        if self.alike and SPACE not in text:
            return SPACE + text.replace(" ", SPACE), None
        data, squeeze = text.encode(), self.m["squeeze"]
        at, out, source = 0, [], []
        before = squeeze
        while at < len(data):
            n, new = self.map.longest(data, at)
            if not n:
                n = 1
                while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                    n += 1
                new = data[at : at + n]
            kept = new.lstrip(b" ") if before else new
            if kept:
                if not out and self.m["prefix"]:
                    out.append(SPACE.encode())
                    source.append((3, at))
                for b in re.findall(rb" |[^ ]+", kept):
                    b = SPACE.encode() if b == b" " else b
                    out.append(b)
                    # each byte of an unchanged character has its own source; a replacement starts where its key starts
                    source.extend([(1, at + i) for i in range(len(b))] if new == data[at : at + n] and b == new else [(len(b), at)])
                before = kept.endswith(b" ") and squeeze
            at += n
        mapped = b"".join(out)
        if squeeze:
            while mapped.endswith(SPACE.encode()):
                mapped = mapped[:-3]
        align = np.repeat(np.array([s for _, s in source], np.int64), [n for n, _ in source])[: len(mapped)] if source else np.zeros(0, np.int64)
        end = len(data) if not squeeze else len(data.rstrip(b" "))
        return mapped.decode(), np.append(align, end)

    # merging -------------------------------------------------------------------------------------------------------------------

    def _merge(self, unit: str) -> list[int]:
        """Ids of one unit: the best-scored neighbours merge first, the leftmost of equal ones."""
        score, parts = self.score.get, list(unit)
        made: dict[str, tuple[str, str]] = {}
        if len(parts) > SHORT:
            parts = self._merge_long(parts, made)
        else:
            pairs = [score(a + b, NONE) for a, b in pairwise(parts)]
            while pairs and (best := max(pairs)) > NONE:
                i = pairs.index(best)
                both = parts[i] + parts[i + 1]
                if self.unused and both in self.unused:
                    made.setdefault(both, (parts[i], parts[i + 1]))
                parts[i] = both
                del parts[i + 1], pairs[i]
                if i:
                    pairs[i - 1] = score(parts[i - 1] + both, NONE)
                if i < len(pairs):
                    pairs[i] = score(both + parts[i + 1], NONE)
        if not made and (ids := self.known(parts)) is not None:
            return ids
        ids = []
        for p in parts:
            self._ids(p, made, ids)
        return ids

    def known(self, parts: list[str]) -> list[int] | None:
        try:
            return [self.plain[p] for p in parts]
        except KeyError:
            return None

    def _merge_long(self, parts: list[str], made: dict[str, tuple[str, str]]) -> list[str]:
        score, n = self.score, len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := score.get(both := parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, b, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not parts[a] or right[a] != b or parts[a] + parts[b] != both:
                continue
            if both in self.unused:
                made.setdefault(both, (parts[a], parts[b]))
            parts[a], parts[b] = both, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p]

    def _ids(self, piece: str, made: dict[str, tuple[str, str]], out: list[int]) -> None:
        if piece in self.unused and piece in made:
            for half in made[piece]:
                self._ids(half, made, out)
        elif piece in self.score:
            out.append(self.id[piece])
        elif self.m["bytes"]:
            out.extend(self.byte[b] for b in piece.encode())
        else:
            out.append(self.unk)

    def _cut(self, unit: str) -> list[str]:
        """The unit in stretches: no piece holds the two characters beside a cut."""
        beside = self.beside
        cuts = [i for i, pair in enumerate(map(concat, unit, unit[1:]), 1) if pair not in beside]
        return [unit[i:j] for i, j in zip([0, *cuts], [*cuts, len(unit)], strict=True)]

    def _packed(self, units: list[str]) -> list[bytes]:
        """The packed ids of different units."""
        if len(units) < TOGETHER or self.unused:
            return [struct.pack(f"<{len(ids)}I", *ids) for ids in map(self._merge, units)]
        out: list[bytes] = [b""] * len(units)
        size = np.fromiter(map(len, units), np.int64, len(units))
        low = 0
        for width in WIDTHS:
            at = np.flatnonzero((size > low) & (size <= width))
            for i, data in zip(at.tolist(), self._merge_table([units[i] for i in at.tolist()], size[at], width), strict=True):
                out[i] = data
            low = width
        if (long := np.flatnonzero(size > low).tolist()):
            cut = [self._cut(units[i]) for i in long]
            stretches = list(dict.fromkeys(s for c in cut for s in c))
            short = [s for s in stretches if len(s) <= low]
            known = dict(zip(short, self._packed(short), strict=True))
            for s in stretches:
                if s not in known:
                    ids = self._merge(s)
                    known[s] = struct.pack(f"<{len(ids)}I", *ids)
            for i, c in zip(long, cut, strict=True):
                out[i] = b"".join(map(known.__getitem__, c))
        return out

    def _merge_table(self, units: list[str], size: np.ndarray, width: int) -> list[bytes]:
        """Packed ids of units of at most ``width`` characters, merged side by side, one merge of each a round."""
        n, keys = len(self.raw), self.pair_keys
        column = np.arange(width)
        table = np.full((len(units), width), -1, np.int64)
        table[column < size[:, None]] = self.symbol[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")]
        odd = np.flatnonzero((table < 0).sum(axis=1) != width - size)  # units with a character that is no piece
        rows = np.arange(len(units))  # those that still merge

        def look(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Place of each pair among the keys; the last place, of score 0, if it does not merge."""
            key = np.where((a >= 0) & (b >= 0), a * n + b, -1)
            at = np.searchsorted(keys, key)
            return np.where(keys[at] == key, at, len(keys) - 1)

        pair = look(table[:, :-1], table[:, 1:])
        out, count = np.full(table.shape, -1, np.int64), size.copy()
        while len(rows):
            score = self.pair_scores[pair]
            best = score.argmax(axis=1)  # the leftmost of equal ones
            going = score[np.arange(len(rows)), best] > 0
            if not going.all():
                out[rows[~going]] = table[~going]
                rows, table, pair, best = rows[going], table[going], pair[going], best[going]
            i = np.arange(len(rows))
            made = self.pair_made[pair[i, best]]
            moved = np.minimum(column + (column > best[:, None]), width - 1)
            table = np.take_along_axis(table, moved, axis=1)
            table[:, -1] = -1
            table[i, best] = made
            pair = np.take_along_axis(pair, np.minimum(moved[:, :-1], width - 2), axis=1)
            pair[:, -1] = len(keys) - 1
            count[rows] -= 1
            pair[i, best] = look(made, table[i, best + 1])
            left = best > 0
            pair[i[left], best[left] - 1] = look(table[i[left], best[left] - 1], made[left])
        data = out[column < count[:, None]].astype("<u4").tobytes()
        ends = (np.cumsum(count) * 4).tolist()
        packed = [data[i:j] for i, j in zip([0, *ends], ends)]
        for i in odd.tolist():
            packed[i] = self._with_others(units[i], out[i, : count[i]].tolist())
        return packed

    def _with_others(self, unit: str, ids: list[int]) -> bytes:
        """The packed ids of a merged unit with characters that are no piece; they stand as negative numbers among ``ids``."""
        if -1 in ids:  # may be part of a piece
            every = self._merge(unit)
        else:
            every, at = [], 0
            for i in ids:
                if i < 0:
                    self._ids(unit[at], {}, every)
                else:
                    every.append(i)
                at += 1 if i < 0 else self.characters[i]
        return struct.pack(f"<{len(every)}I", *every)

    def _words(self, text: str) -> list[str] | None:
        """With single spaces and nothing else changed, the words of the text are its units, each with the space before it."""
        plain = self.alike and self.apart and text and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " "
        return text.split(" ") if plain else None

    def _fill(self, cache: dict[str, bytes], units: set[str], before: str) -> None:
        """Put the packed ids of those units that are new into ``cache``, each encoded with ``before`` ahead of it."""
        new = list(units.difference(cache))
        cache.update(zip(new, self._packed([before + u for u in new] if before else new), strict=True))

    def prepare(self, texts: list[str]) -> None:
        """Encode the new words of many texts side by side; ``encode`` then finds them."""
        if len(self.cache) >= CACHE:
            self.cache.clear()
        new: set[str] = set()
        for t in texts:
            new.update(self._words(t) or ())
        self._fill(self.cache, new, SPACE)

    def encode(self, text: str, spans: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Ids, and the first byte and the byte after the last of each piece in the source."""
        units, before, cache, align, norm = self._words(text), SPACE, self.cache, None, ""
        if units is None:
            norm, align = self.normalise(text)
            units, before, cache = self.units.findall(norm), "", self.other
        try:
            data = b"".join(map(cache.__getitem__, units))
        except KeyError:
            if len(cache) >= CACHE:
                cache.clear()
            self._fill(cache, set(units), before)
            data = b"".join(map(cache.__getitem__, units))
        which = np.frombuffer(data, "<u4")
        if not spans:
            return which, None, None
        if align is None:
            ends = np.cumsum(self.source_width[which]) - 1  # the added space has no source byte
            begins = np.append(0, ends[:-1]) if len(ends) else ends
            return which, begins, ends
        ends = np.cumsum(self._widths(which, norm))
        begins = np.append(0, ends[:-1]) if len(ends) else ends
        return which, align[begins], align[ends]

    def _widths(self, which: np.ndarray, norm: str) -> np.ndarray:
        widths = self.width[which].copy()
        if (unknown := np.flatnonzero(which == self.unk)).size:  # an unknown piece is one character of the text
            data, at = norm.encode(), 0
            for i in range(len(which)):
                if which[i] == self.unk:
                    n = 1
                    while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                        n += 1
                    widths[i] = n
                at += widths[i]
            assert unknown.size
        return widths

    def decode(self, ids: list[int]) -> str:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        data = b"".join(map(self.raw.__getitem__, ids))
        if (self.m["prefix"] or self.m["squeeze"]) and ids and data[:1] == b" " and self.m["types"][next((i for i in ids if self.raw[i]), ids[0])] in (NORMAL, UNUSED):
            data = data.lstrip(b" ") if self.m["squeeze"] else data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._decode_bytes(ids)

    def _decode_bytes(self, ids: list[int]) -> str:
        """Each byte that is not part of a character becomes U+FFFD."""
        out: list[str] = []
        run = b""
        for i in [*ids, None]:
            if i is not None and self.m["types"][i] == BYTE:
                run += self.raw[i]
                continue
            while run:
                n = next((k for k in (1, 2, 3, 4) if _one_char(run[:k])), 0)
                out.append(run[:n].decode() if n else "�")
                run = run[n or 1 :]
            if i is not None:
                piece = self.raw[i].decode()
                if not "".join(out) and piece.startswith(" ") and (self.m["prefix"] or self.m["squeeze"]):
                    piece = piece.lstrip(" ") if self.m["squeeze"] else piece[1:]
                out.append(piece)
        return "".join(out)


def _one_char(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def encode(df: DataFrame, model: dict, text: str = "text", key: str = "doc_id", add_eos: bool = True) -> DataFrame:
    """One row per row of ``df``: the key, ``ids``, and ``begins``/``ends``, the bytes of the source each piece covers.

    A null text is encoded as an empty one (the end id alone, with an empty span at the end of the text). Repeated rows are kept.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(data: dict, codec: Codec) -> dict:
        ids, begins, ends = [], [], []
        codec.prepare(data["_text"])
        for t in data["_text"]:
            i, b, e = codec.encode(t)
            if add_eos:
                size = len(t.encode())
                i, b, e = np.append(i, codec.m["eos"]), np.append(b, size), np.append(e, size)
            ids.append(i)
            begins.append(b)
            ends.append(e)
        return {key: data[key], "ids": ids, "begins": begins, "ends": ends}

    schema = f"`{key}` {dict(df.dtypes)[key]}, ids array<int>, begins array<bigint>, ends array<bigint>"
    return per_batch(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")), schema, run, lambda: Codec(sent.value))


def decode(df: DataFrame, model: dict, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """The key and ``text``, the decoded ids; null ids give an empty text."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(data: dict, codec: Codec) -> dict:
        return {key: data[key], "text": [codec.decode(i or []) for i in data["_ids"]]}

    return per_batch(df.select(key, F.col(ids).alias("_ids")), f"`{key}` {dict(df.dtypes)[key]}, text string", run, lambda: Codec(sent.value))


def digest(df: DataFrame, model: dict, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode with an end id, project the pieces to source bytes, decode again; per row what identifies the results.

    ``n_tokens``, ``ids_sha256`` (decimal ids joined by a space), ``decoded_sha256``, ``spans_crc32`` (first bytes, then ends, as little-endian
    32-bit numbers), ``whole`` (the spans follow each other from byte 0 to the end of the source). Same rules for null as ``encode``.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(data: dict, codec: Codec) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32", "whole")}
        codec.prepare(data["_text"])
        for t in data["_text"]:
            ids, begins, ends = codec.encode(t)
            ids = [*ids.tolist(), codec.m["eos"]]
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(" ".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            out["spans_crc32"].append(zlib.crc32(ends.astype("<i4").tobytes(), zlib.crc32(begins.astype("<i4").tobytes())))
            out["whole"].append(not len(ends) or bool(begins[0] == 0 and ends[-1] == len(t.encode()) and (begins[1:] == ends[:-1]).all()))
        return {key: data[key], **out}

    schema = f"`{key}` {dict(df.dtypes)[key]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint, whole boolean"
    return per_batch(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")), schema, run, lambda: Codec(sent.value))
