"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, memory-mapped by the workers.

Training counts words, then the n-grams of the highest order (``order``, 3 by default), and from the
distinct n-grams of each order the continuation counts of the next lower one. The model is a folder of
plain arrays in the shared checkpoint folder, which must be a path mounted on every worker (the files are
mapped, not copied, so they take no worker memory):

* ``vocabulary``: the sorted 64-bit hashes of all training tokens; a token's rank is its id;
* ``words``: per id its count, its followers with counts 1, 2 and more, the sum of its followers' counts and
  its predecessors;
* ``gN-k.high``, ``.low``, ``.counts``: the sorted hashes of the N-grams of the k-th share (48 bits, as 32 and
  16; within a share of some million that is about one false match in 10^8 look-ups) with their counts, those
  of the highest order as they occur, of lower ones by how many different words go before, in a byte each;
* ``xN-k.high``, ``.low``, ``.sums``: the same for the contexts of N-grams of three words and more: the sum of
  counts and how many followers have counts 1, 2 and more, in two bytes (``_coded``);
* ``.over``, ``.rows`` of counts and sums: the places of those that do not fit, and they themselves.

Each level is written before the next is dealt, and its shuffle files deleted. Everything gathered grows with the corpus; a share holds about ``SHARE`` n-grams, so tasks stay small.
Pairs are dealt by their own hash and the sums per first word folded afterwards, longer n-grams by their
context's, so no share holds all that follows a frequent word. Tasks write with an atomic rename or at a
fixed offset, so a repeated task changes nothing.

Tokens are the A-Z-lower-cased words ``[^\\x20\\x09-\\x0D]+`` and one end per text; null is empty. A text
begins with ``order - 1`` start marks. Texts with a null ``doc_id`` are scored but not learnt from. Every row
gives a row; extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize, remove, shared_dir
from .textarrays import U, Words, mix, pieces, shape

END = mix(np.array([0xE0D], U))[0]
#: N-grams and words of one share.
SHARE, WORD_SHARE = 2_000_000, 1_000_000
#: N-grams or words that a task holds before it passes them on.
HELD = 3_000_000
_PRIME = U(0x9E3779B97F4A7C15)


def _replace(path: str, data: np.ndarray) -> None:
    """Write a whole file; readers and repeated tasks see the old one or the new one."""
    part = f"{path}.{uuid.uuid4().hex}"
    data.tofile(part)
    os.replace(part, path)


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and ends of all texts in a row, and where each text's tokens begin."""
    words = Words(batch.column("text"), lower=True)
    at = words.at + np.arange(len(words.at))
    out = np.empty(int(at[-1]), U)
    end = np.zeros(len(out), bool)
    end[at[1:] - 1] = True
    out[end], out[~end] = END, words.hashes()
    return out, at


def _sorted_places(keys: np.ndarray) -> np.ndarray:
    """A stable ``argsort`` of whole numbers from 0 on: their first bits are sorted together with their places, which takes a
    fraction of the time; where those bits do not tell all apart, all bits are."""
    if len(keys) < 2:
        return np.arange(len(keys))
    bits = (len(keys) - 1).bit_length()
    drop = max(0, int(keys.max()).bit_length() + bits - 64)
    both = keys.astype(U) >> U(drop) << U(bits) | np.arange(len(keys), dtype=U)
    both.sort()
    order = (both & U((1 << bits) - 1)).view(np.int64)
    if drop:
        own = keys[order]
        if (own[1:] < own[:-1]).any() or ((own[1:] == own[:-1]) & (order[1:] < order[:-1])).any():
            return np.argsort(keys, kind="stable")
    return order


def _add(held: list, keys: np.ndarray, counts: np.ndarray) -> None:
    held.append((keys, counts))
    while len(held) > 1 and len(held[-2][0]) < 2 * len(held[-1][0]):
        (k1, c1), (k2, c2) = held.pop(), held.pop()
        held.append(_merged(np.concatenate([k1, k2]), np.concatenate([c1, c2])))


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = _sorted_places(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _all(held: list) -> tuple[np.ndarray, np.ndarray]:
    return _merged(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])) if held else (np.empty(0, U), np.empty(0, np.int64))


def gram_keys(ids: list[np.ndarray]) -> list[np.ndarray]:
    """The keys of the n-grams of the first two, three, ... of these columns of ids."""
    keys = [ids[0].astype(U) << U(32) | ids[1].astype(U)]
    for column in ids[2:]:
        keys.append(mix(keys[-1] * _PRIME + column.astype(U) + U(1)))
    return keys


def _stored(keys: np.ndarray, n: int) -> np.ndarray:
    """The keys of n-grams as hashes; those of pairs are not hashed yet."""
    return mix(keys) if n == 2 else keys


def _halves(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 48 bits, as 32 and 16."""
    return (hashes >> U(32)).astype(np.uint32), (hashes >> U(16)).astype(np.uint16)


def _share(key: np.ndarray, n: int) -> np.ndarray:
    return ((mix(key + U(7)) >> U(40)) % U(n)).astype(np.int64)


def shares_of(keys: list[np.ndarray], n: int) -> np.ndarray:
    """The share of each n-gram: by itself for pairs, by its context else."""
    return _share(keys[max(len(keys) - 2, 0)], n)


class Model:
    """The mapped arrays and the numbers that go with them."""

    def __init__(self, folder: str, facts: dict):
        self.folder, self.facts, self.maps = folder, facts, {}

    def open(self) -> Model:
        v, f = self.facts["vocabulary"], self.facts
        self.hashes = self._map("vocabulary", U)
        self.words = self._map("words", f["kind"]).reshape(-1, 6) if v else np.zeros((1, 6), np.int64)
        return self

    def _map(self, name: str, kind) -> np.ndarray:
        path = f"{self.folder}/{name}"
        return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.empty(0, kind)

    def _table(self, name: str, values: str, width: int) -> tuple[np.ndarray, ...]:
        """Both parts of the keys of a share, the coded values, and the places and rows of those that have no code; the rows' type follows from the sizes of the files."""
        if name not in self.maps:
            over = self._map(f"{name}.{values}.over", np.uint32)
            size = os.path.getsize(f"{self.folder}/{name}.{values}.rows") // (len(over) * width) if len(over) else 1
            rows = self._map(f"{name}.{values}.rows", f"u{size}").reshape(-1, width)
            self.maps[name] = self._map(f"{name}.high", np.uint32), self._map(f"{name}.low", np.uint16), self._map(f"{name}.{values}", _CODE[width]), over, rows
        return self.maps[name]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each token, -1 where it was not seen."""
        order = _sorted_places(hashes)
        keys = hashes[order]
        new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        out = np.empty(len(keys), np.int64)
        out[order] = self._find(self.hashes, keys[new])[np.cumsum(new) - 1]
        return out

    @staticmethod
    def _find(table: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.full(len(sorted_keys), -1, np.int64)
        at = np.searchsorted(table, sorted_keys)
        at[at == len(table)] = 0
        return np.where(table[at] == sorted_keys, at, -1)

    def look_up(self, prefix: str, values: str, width: int, keys: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of values of the different keys, zeros where there is none, and the row of each key."""
        order = _sorted_places(keys)
        keys, share = keys[order], share[order]
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (share[1:] != share[:-1]))) if len(keys) else np.empty(0, np.int64)
        k, s = keys[first], share[first]
        found = np.zeros((len(k), width), self.facts["kind"])
        by = _sorted_places(s)
        for at in np.split(by, np.flatnonzero(np.diff(s[by])) + 1) if len(k) else []:
            high, low, *coded = self._table(f"{prefix}-{s[at[0]]}", values, width)
            h, l_ = _halves(k[at])
            place = np.searchsorted(high, h)
            while len(at):  # on along equal first halves
                inside = place < len(high)
                at, h, l_, place = at[inside], h[inside], l_[inside], place[inside]
                same = high[place] == h
                at, h, l_, place = at[same], h[same], l_[same], place[same]
                hit = low[place] == l_
                found[at[hit]] = _decoded(*coded, place[hit])
                at, h, l_, place = at[~hit], h[~hit], l_[~hit], place[~hit] + 1
        back = np.empty(len(keys), np.int64)
        back[order] = np.repeat(np.arange(len(k)), np.diff(np.append(first, len(keys))))
        return found, back

    def log10(self, ids: list[np.ndarray]) -> np.ndarray:
        """log10 of P(the last | the others); ``order`` columns of ids, -1 where unseen."""
        f = self.facts
        last = ids[-1]
        cont = np.where(last >= 0, np.asarray(self.words[np.maximum(last, 0), 5], np.float64), 0)
        d = f["discounts"][1]
        if f["pairs"]:
            p = (np.maximum(cont - _discount(d, cont), 0) + f["low_rest"] / (f["vocabulary"] + 1)) / f["pairs"]
        else:
            p = np.full(len(last), 1 / (f["vocabulary"] + 1))
        for n in range(2, f["order"] + 1):
            d = f["discounts"][n]
            own = ids[-n:]
            context = np.all([x >= 0 for x in own[:-1]], axis=0)
            both = context & (last >= 0)
            total, rest, count = np.zeros((3, len(last)))
            keys = gram_keys([np.maximum(x, 0) for x in own])
            share = shares_of(keys, f["n_shares"])
            found, back = self.look_up(f"g{n}", "counts", 1, _stored(keys[-1], n)[both], share[both])
            count[both] = found[back, 0]
            if n == 2:
                found, back = self.words, own[0][context]
                total[context] = found[back, 4]
                rest[context] = sum(found[back, k] * d[k - 1] for k in (1, 2, 3))
            else:
                found, back = self.look_up(f"x{n}", "sums", 4, _stored(keys[-2], n - 1)[context], share[context])
                total[context] = found[back, 0]
                rest[context] = sum(found[:, k] * d[k - 1] for k in (1, 2, 3))[back]
            seen = total > 0
            high = (np.maximum(count - _discount(d, count), 0) + rest * p) / np.where(seen, total, 1)
            p = np.where(seen, high, p)
        return np.log10(p)


def _discount(d: tuple, count: np.ndarray) -> np.ndarray:
    return np.select([count <= 0, count <= 1, count <= 2], [0.0, d[0], d[1]], d[2])


def discounts(n: tuple) -> tuple[float, float, float]:
    """The three discounts from how many items have counts 1 to 4; plain halves where those say nothing."""
    n1, n2, n3, n4 = (float(x or 0) for x in n)
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    clip = lambda x, top: min(max(x, 0.05), top)
    return clip(1 - 2 * y * n2 / n1, 1.0), clip(2 - 3 * y * n3 / n2, 2.0), clip(3 - 4 * y * n4 / n3, 3.0) if n3 else 1.5


def _columns(ids: np.ndarray, at: np.ndarray, start: int, order: int) -> list[np.ndarray]:
    """The ``order`` last ids at each token, start marks before a text's first."""
    columns = [ids]
    place = np.arange(len(ids)) - np.repeat(at[:-1], np.diff(at))
    for back in range(1, order):
        columns.insert(0, np.where(place < back, start, np.roll(ids, back)))
    return columns


def _packed(columns: list[np.ndarray], counts: np.ndarray | None, share: np.ndarray, n_shares: int) -> Iterator[tuple[int, bytes]]:
    """Each share's n-grams as compressed byte planes; without counts they may repeat and are counted here, a share at a time."""
    order = _sorted_places(share)
    ends = np.searchsorted(share, np.arange(n_shares + 1), sorter=order)
    pack = zstandard.ZstdCompressor(level=1)
    for k in np.flatnonzero(np.diff(ends)):
        mine = order[ends[k] : ends[k + 1]]
        own = [c[mine] for c in columns]
        if counts is None:
            own, _, count = _distinct(own, None)
        else:
            count = counts[mine]
        by = np.arange(len(own[0]))
        for c in reversed(own):  # like next to like
            by = by[_sorted_places(c[by])]
        planes = [np.ascontiguousarray(x[by].astype(t).view(np.uint8).reshape(len(by), -1).T).tobytes() for x, t in [*((c, np.uint32) for c in own), (count, np.uint64)]]
        yield int(k), pack.compress(b"".join(planes))


def _unpacked(parts: list[bytes], n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns and counts of all parts; each is unpacked into its place, so nothing is held twice."""
    width = 4 * n + 8
    ends = np.cumsum([0] + [zstandard.frame_content_size(x) // width for x in parts])
    columns, counts = [np.empty(ends[-1], np.uint32) for _ in range(n)], np.empty(ends[-1], np.int64)
    unpack = zstandard.ZstdDecompressor()
    for x, a, b in zip(parts, ends[:-1], ends[1:], strict=True):
        planes = np.frombuffer(unpack.decompress(x), np.uint8).reshape(width, -1)
        for i, out in enumerate([*columns, counts]):
            out[a:b] = np.ascontiguousarray(planes[4 * i : 4 * i + out.itemsize].T).view(out.dtype).ravel()
    return columns, counts


def _distinct(columns: list[np.ndarray], counts: np.ndarray | None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Columns, keys and summed counts of the different n-grams, sorted by the stored key. The list of columns is used up."""
    keys = gram_keys(columns)
    key = _stored(keys[-1], len(columns))
    order = _sorted_places(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    del key
    total = np.diff(np.append(first, len(order))) if counts is None else (np.add.reduceat(counts[order], first) if len(order) else counts)
    order = order[first]
    del first
    for x in (columns, keys):
        for i in range(len(x)):
            x[i] = x[i][order]
    return columns, keys, total


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


#: Type of a code of values of such a width; its largest value stands for those that have none.
_CODE = {1: np.uint8, 4: np.uint16}


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of counts or of rows ``(sum, n1, n2, n3)``, the places of those that have none, and these.

    Up to 254 a count is its own code. A row's has four bits for n1, two each for n2 and n3 and a byte for what the
    sum is above ``n1 + 2 n2 + 3 n3``.
    """
    values = values.reshape(len(values), -1)
    if values.shape[1] == 1:
        fits, code = values[:, 0] < 255, values[:, 0]
    else:
        total, n1, n2, n3 = values.T
        more = total - n1 - 2 * n2 - 3 * n3
        fits, code = (n1 < 16) & (n2 < 4) & (n3 < 4) & (more < 255), n1 << 12 | n2 << 10 | n3 << 8 | more
    kind = _CODE[values.shape[1]]
    over = np.flatnonzero(~fits)
    return np.where(fits, code, np.iinfo(kind).max).astype(kind), over.astype(np.uint32), _narrow(values[over])


def _decoded(code: np.ndarray, over: np.ndarray, rows: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The rows of values at these places."""
    own = code[place].astype(np.int64)
    if code.dtype == np.uint8:
        out = own[:, None]
    else:
        n1, n2, n3 = own >> 12, own >> 10 & 3, own >> 8 & 3
        out = np.stack([n1 + 2 * n2 + 3 * n3 + (own & 255), n1, n2, n3], 1)
    none = np.flatnonzero(own == np.iinfo(code.dtype).max)
    if len(none):
        out[none] = rows[np.searchsorted(over, place[none].astype(np.uint32))]
    return out


def train(documents: DataFrame, order: int = 3) -> Model:
    """Count ``documents`` (``text``) and write the model of ``order`` (2 or more)."""
    spark = documents.sparkSession
    where = urlparse(shared_dir(spark))
    if where.scheme not in ("", "file"):
        raise ValueError(f"the model is memory-mapped: spark.checkpoint.dir must be mounted on the workers, not {where.scheme}")
    folder = f"{where.path}/model-{uuid.uuid4().hex}"
    texts = documents.select(F.col("text").cast("string").alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]):
        held: list = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in _all(held)], names=["word", "c"])
        for batch in pieces(batches):
            keys, counts = np.unique(_tokens(batch)[0], return_counts=True)
            _add(held, keys, counts)
            if sum(len(k) for k, _ in held) > HELD:
                yield flush()
                held.clear()
        yield flush()

    words = materialize(texts.mapInArrow(count_words, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), clean=True)
    vocabulary, tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    kind = "u4" if tokens < 2**32 else "u8"
    facts = {"vocabulary": vocabulary, "tokens": tokens, "kind": kind, "order": order, "n_shares": 1, "pairs": 0, "discounts": {n: (0.5,) * 3 for n in range(1, order + 1)}, "low_rest": 0.0}
    if not vocabulary:
        return Model(folder, facts)

    bits = max(1, int(np.ceil(np.log2(vocabulary / WORD_SHARE))) if vocabulary > WORD_SHARE else 1)
    # hashes are unsigned: flipping the sign bit makes signed top bits follow their order
    top = F.shiftright(F.col("word").bitwiseXOR(F.lit(-(2**63))), 64 - bits) + F.lit(2 ** (bits - 1))
    shared = words.withColumn("share", top)
    sizes = dict(shared.groupBy("share").count().collect())
    offset = dict(zip(sorted(sizes), np.concatenate([[0], np.cumsum([sizes[k] for k in sorted(sizes)])]).tolist(), strict=False))

    def write_words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h = table["word"].to_numpy().view(U)
        order = np.argsort(h)
        begin = offset[key[0].as_py()]
        os.makedirs(folder, exist_ok=True)
        with open(os.open(f"{folder}/vocabulary", os.O_RDWR | os.O_CREAT, 0o644), "r+b") as f:
            os.pwrite(f.fileno(), h[order].tobytes(), 8 * begin)
        return pa.table({"id": np.arange(begin, begin + len(h)), "c": table["c"].to_numpy()[order]})

    counted = materialize(shared.groupBy("share").applyInArrow(write_words, "id long, c long"), clean=True)
    discard(words)
    n_shares = max(1, -(-tokens // SHARE))
    facts["n_shares"] = n_shares
    kinds = {"share": pa.int32(), "data": pa.binary(), **{c: pa.int64() for c in ("id", "n1", "n2", "n3", "total", "cont")}}
    shape = "share int, data binary, id long, n1 long, n2 long, n3 long, total long, cont long"

    def batch_of(n: int, **columns) -> pa.Table:
        return pa.table({k: pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()})

    def count_grams(batches: Iterator[pa.RecordBatch]):
        model, held, size = None, [], 0

        def flush():
            share, *columns = [np.concatenate([x.pop() for x in held]) for _ in range(order + 1)]  # from the last column on
            for k, data in _packed(columns[::-1], None, share, n_shares):
                yield from batch_of(1, share=[k], data=[data]).to_batches()

        for batch in pieces(batches):
            if model is None:
                model = Model(folder, facts)
                model.hashes = np.memmap(f"{folder}/vocabulary", U, "r")
            h, at = _tokens(batch)
            columns = [x.astype(np.uint32) for x in _columns(model.ids(h), at, vocabulary, order)]
            held.append([*columns, shares_of(gram_keys(columns), n_shares).astype(np.uint32)])
            size += len(h)
            if size > HELD:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def write_level(n: int):
        """Of a share of n-grams: its files, the sums of its contexts, and the n-grams one word shorter for the next level."""

        def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            k = key[0].as_py()
            if k < 0:
                return table
            columns, keys, counts = _distinct(*_unpacked(table["data"].to_pylist(), n))

            def put(name: str, hashes: np.ndarray, values: np.ndarray, kind: str) -> None:
                by = _sorted_places(hashes)
                for part, data in zip(("high", "low", kind, f"{kind}.over", f"{kind}.rows"), (*_halves(hashes[by]), *_coded(values[by])), strict=True):
                    _replace(f"{folder}/{name}-{k}.{part}", data)

            put(f"g{n}", _stored(keys[-1], n), counts, "counts")
            of = [int((counts == c).sum()) for c in (1, 2, 3, 4)]
            out = [batch_of(1, share=[-1], id=[-n], n1=[of[0]], n2=[of[1]], n3=[of[2]], total=[of[3]], cont=[0])]
            by = keys[-2] if n > 2 else columns[0]
            del keys
            order_ = _sorted_places(by)
            by = by[order_]
            begin = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
            context, counts = by[begin], counts[order_]
            del by, order_
            sums = [np.add.reduceat(x, begin, dtype=np.int64) for x in (counts, counts == 1, counts == 2, counts > 2)]
            del begin, counts
            if n > 2:
                put(f"x{n}", _stored(context, n - 1), np.stack(sums, 1), "sums")
                del sums, context
                shorter, short_keys, conts = _distinct(columns[1:], None)
                packed = list(_packed(shorter, conts, shares_of(short_keys, n_shares), n_shares))
                out.append(batch_of(len(packed), share=[p[0] for p in packed], data=[p[1] for p in packed]))
            else:
                after, conts = np.unique(columns[1], return_counts=True)
                zero = np.zeros(len(after), np.int64)
                out.append(batch_of(len(context), share=np.full(len(context), -1), id=context, n1=sums[1], n2=sums[2], n3=sums[3], total=sums[0], cont=np.zeros(len(context), np.int64)))
                out.append(batch_of(len(after), share=np.full(len(after), -1), id=after, n1=zero, n2=zero, n3=zero, total=zero, cont=conts))
            return pa.concat_tables(out)

        return write

    rows = texts.mapInArrow(count_grams, shape)
    for n in range(order, 1, -1):
        longer, rows = rows, materialize(rows.groupBy("share").applyInArrow(write_level(n), shape), clean=True)
        discard(longer)
    sums = materialize(rows.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "total", "cont")]), clean=True)
    discard(rows)
    notes = {-r["id"]: r for r in sums.where("id < 0").collect()}  # one a level
    counts = [F.count(F.when(F.col("cont") == k, 1)) for k in (1, 2, 3, 4)] + [F.count(F.when(F.col("cont") > 2, 1)), F.sum("cont")]
    m1, m2, m3, m4, more, total = sums.where("id >= 0").agg(*counts).first()
    facts["pairs"] = total
    facts["discounts"] = {1: discounts((m1, m2, m3, m4)), **{n: discounts((r["n1"], r["n2"], r["n3"], r["total"])) for n, r in notes.items()}}
    facts["low_rest"] = float(np.dot(facts["discounts"][1], (m1, m2, more)))

    def write_rows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        begin = key[0].as_py() * WORD_SHARE
        ids = table["id"].to_numpy() - begin
        rows = np.zeros((min(WORD_SHARE, vocabulary + 1 - begin), 6), kind)
        for i, c in enumerate(("c", "n1", "n2", "n3", "total", "cont")):
            rows[ids, i] = table[c].to_numpy()
        with open(os.open(f"{folder}/words", os.O_RDWR | os.O_CREAT, 0o644), "r+b") as f:
            os.pwrite(f.fileno(), rows.tobytes(), begin * rows.itemsize * 6)
        return pa.table({"n": pa.array([len(ids)], pa.int64())})

    per_word = sums.where("id >= 0").join(counted, "id", "full_outer").na.fill(0).withColumn("share", (F.col("id") / WORD_SHARE).cast("long"))
    per_word.groupBy("share").applyInArrow(write_rows, "n long").agg(F.sum("n")).first()
    discard(counted, sums)
    return Model(folder, facts)


def score(documents: DataFrame, model: Model, *columns: str) -> DataFrame:
    """Per row the given columns, ``n_tokens, n_known, base_score`` (add-one words) and ``score`` (the model)."""
    folder, facts = model.folder, model.facts
    rows = documents.select(*columns, F.col("text").cast("string").alias("text"))

    def go(batches: Iterator[pa.RecordBatch]):
        m = None
        for batch in pieces(batches):
            m = m or Model(folder, facts).open()
            h, at = _tokens(batch)
            ids = m.ids(h)
            c = np.where(ids >= 0, m.words[np.maximum(ids, 0), 0], 0).astype(np.float64)
            base = np.log10((c + 1) / (facts["tokens"] + facts["vocabulary"] + 1))
            add = lambda x: np.add.reduceat(x, at[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in columns] + [pa.array(np.diff(at)), pa.array(add((ids >= 0).astype(np.int64))),
                                             pa.array(add(base)), pa.array(add(m.log10(_columns(ids, at, facts["vocabulary"], facts["order"]))))], names=[*columns, "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(go, shape(rows, columns, "n_tokens long, n_known long, base_score double, score double"))


def held_out_scores(documents: DataFrame, fold: int = 2, folds: int = 7, order: int = 3) -> DataFrame:
    """Learn from texts whose crc32(doc_id) mod ``folds`` is not ``fold``; score all, then delete the model.

    ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)``.
    """
    rest = F.crc32(F.col("doc_id").cast("string")) % folds
    model = train(documents.where(rest != fold), order)
    rows = documents.select("doc_id", F.coalesce(rest == fold, F.lit(False)).alias("held_out"), "text")
    scored = materialize(score(rows, model, "doc_id", "held_out"))
    remove(rows.sparkSession, model.folder)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.facts["tokens"]).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
