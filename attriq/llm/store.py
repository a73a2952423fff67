"""Arrays in files of the shared folder, memory-mapped by those who read them."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections import OrderedDict
from urllib.parse import unquote, urlparse

import numpy as np
from pyarrow import fs


def local_path(uri: str) -> str | None:
    """The path of a folder that is mounted everywhere; None if only a file system's own client reads it."""
    at = urlparse(uri)
    return unquote(at.path) if at.scheme in ("", "file") else None


def _put(uri: str, shard: int, parts: list[bytes]) -> None:
    """A file, whole under another name and then renamed: a task that runs again or twice puts the same bytes in place."""
    folder = local_path(uri)
    if folder is not None:
        os.makedirs(folder, exist_ok=True)
        with open(tmp := f"{folder}/.{shard}-{uuid.uuid4().hex}", "wb") as f:
            f.writelines(parts)
        os.replace(tmp, f"{folder}/{shard}")
        return
    client, path = fs.FileSystem.from_uri(uri)
    client.create_dir(path, recursive=True)
    with client.open_output_stream(tmp := f"{path}/.{shard}-{uuid.uuid4().hex}") as f:
        for p in parts:
            f.write(p)
    client.move(tmp, f"{path}/{shard}")


def _mapped(uri: str, shard: int) -> mmap.mmap:
    """A file in memory as far as it is read; an error if it isn't there."""
    folder = local_path(uri)
    if folder is not None:
        with open(f"{folder}/{shard}", "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    client, path = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as f, client.open_input_stream(f"{path}/{shard}") as g:  # gone when unmapped
        while block := g.read(1 << 24):
            f.write(block)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


class _Files:
    """Files of arrays under one folder, one a shard, of which up to `maps` are kept open."""

    def __init__(self, uri: str, maps: int):
        self.uri, self.maps = uri.rstrip("/"), maps
        self.opened: OrderedDict[int, dict[str, np.ndarray]] = OrderedDict()

    def put(self, shard: int, arrays: dict[str, np.ndarray]) -> None:
        """The arrays, each in its own type; every array starts at a multiple of eight bytes."""
        head = [np.array([len(arrays)], dtype="<u8").tobytes()]
        body = []
        for x in arrays.values():
            head.append(np.array([len(x), x.dtype.itemsize], dtype="<u8").tobytes())
            data = np.ascontiguousarray(x, dtype=x.dtype.newbyteorder("<")).tobytes()
            body += [data, bytes(-len(data) % 8)]
        _put(self.uri, shard, head + body)

    def get(self, shard: int, names: list[str]) -> dict[str, np.ndarray]:
        if shard in self.opened:
            self.opened.move_to_end(shard)
            return self.opened[shard]
        data = _mapped(self.uri, shard)
        sizes = np.frombuffer(data, "<u8", 1 + 2 * len(names)).astype(np.int64)
        out, at = {}, 8 * len(sizes)
        for name, n, width in zip(names, sizes[1::2], sizes[2::2], strict=True):
            out[name] = np.frombuffer(data, f"<u{width}", n, at) if n else np.zeros(0, dtype=f"<u{width}")
            at += int(n * width + 7) // 8 * 8
        self.opened[shard] = out
        while len(self.opened) > self.maps:
            self.opened.popitem(last=False)
        return out


class Columns(_Files):
    """Files of equally long columns of fixed types."""

    def __init__(self, uri: str, columns: list[tuple[str, str]], maps: int = 512):
        super().__init__(uri, maps)
        self.columns = columns

    def write(self, shard: int, arrays: dict[str, np.ndarray]) -> None:
        """Each column in the least unsigned type that holds it and is no wider than its own."""
        self.put(shard, {c: _least(arrays[c], np.dtype(kind).itemsize) for c, kind in self.columns})

    def read(self, shard: int) -> dict[str, np.ndarray]:
        return self.get(shard, [c for c, _ in self.columns])


def _least(x: np.ndarray, most: int = 8) -> np.ndarray:
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype("u1")
    return x.astype(min(kind, np.dtype(f"u{most}"), key=lambda k: k.itemsize))


class Buckets(_Files):
    """Sorted 64-bit keys with columns of numbers, in few bytes.

    Keys are sorted and lie in buckets by their first bits; only 32 bits more are kept of each, so two keys
    of a bucket are taken for one with a chance of 2 ** -32. Numbers take a byte; larger ones are 255 there
    and stand in a list of their own.
    """

    #: Keys of a bucket, about.
    BUCKET = 32

    def __init__(self, uri: str, columns: list[str], maps: int = 512):
        super().__init__(uri, maps)
        self.names = ["bits", "offsets", "rest", *[f"{c}{part}" for c in columns for part in ("", "_at", "_value")]]
        self.columns = columns

    def write(self, shard: int, keys: np.ndarray, values: list[np.ndarray]) -> None:
        bits = min(30, max(0, (len(keys) // self.BUCKET).bit_length()))
        order = np.argsort(keys)
        keys = keys[order]
        bucket = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), dtype=np.uint64)
        out = {
            "bits": np.array([bits], dtype=np.uint8), "offsets": _least(np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64))),
            "rest": (keys >> np.uint64(32 - bits)).astype(np.uint32),
        }
        for c, x in zip(self.columns, values, strict=True):
            x = x[order]
            large = np.flatnonzero(x >= 255)
            out |= {c: np.minimum(x, 255).astype(np.uint8), f"{c}_at": _least(large), f"{c}_value": _least(x[large])}
        self.put(shard, out)

    def find(self, shard: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
        """The columns, as float64, at keys that are sorted within sorted shards; 0 where a key is absent."""
        out = [np.zeros(len(key)) for _ in self.columns]
        edges = [0, *np.flatnonzero(np.diff(shard)) + 1, len(key)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            t = self.get(int(shard[a]), self.names)
            n = len(t["rest"])
            if not n:
                continue
            bits, mine = int(t["bits"][0]), key[a:b]
            bucket = (mine >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(b - a, dtype=np.int64)
            rest = (mine >> np.uint64(32 - bits)).astype(np.uint32)
            low, high = t["offsets"][bucket].astype(np.int64), t["offsets"][bucket + 1].astype(np.int64)
            end = high.copy()
            while (open_ := low < high).any():  # the first place of each bucket that isn't under the key
                middle = (low + high) // 2
                under = open_ & (t["rest"][np.minimum(middle, n - 1)] < rest)
                low, high = np.where(under, middle + 1, low), np.where(open_ & ~under, middle, high)
            hit = np.flatnonzero((low < end) & (t["rest"][np.minimum(low, n - 1)] == rest))
            at = low[hit]
            for c, x in zip(self.columns, out, strict=True):
                value = t[c][at].astype(float)
                large = np.flatnonzero(value == 255)
                value[large] = t[f"{c}_value"][np.searchsorted(t[f"{c}_at"], at[large])]
                x[a + hit] = value
        return out
