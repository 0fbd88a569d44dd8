"""Small writers of both versions of the layout, apart from the library, as fixtures."""

import gzip
import itertools
import json
import os
import zlib

import numpy as np


def write_array(path: str, values: np.ndarray, chunks: tuple[int, ...], codec: str | None = "zlib", skip_empty: bool = False) -> None:
    """Small writer of version 2 (with ``skip_empty`` chunks of zeros are left out), for fixtures and for pre-creating an array that tasks then fill chunk by chunk."""
    os.makedirs(path, exist_ok=True)
    meta = {"zarr_format": 2, "shape": list(values.shape), "chunks": list(chunks), "dtype": values.dtype.str, "compressor": {"id": codec} if codec else None, "fill_value": 0, "order": "C", "filters": None}
    with open(os.path.join(path, ".zarray"), "w") as f:
        json.dump(meta, f)
    for chunk in itertools.product(*[range(-(-s // c)) for s, c in zip(values.shape, chunks, strict=True)]):
        part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(chunk, chunks, strict=True))]
        if part.any() or not skip_empty:
            write_chunk(path, part, chunk, chunks, codec)


def write_chunk(path: str, part: np.ndarray, chunk: tuple[int, ...], chunks: tuple[int, ...], codec: str | None = "zlib") -> None:
    """Write one chunk, padded to the chunk shape, under its final name by a rename."""
    full = np.zeros(chunks, dtype=part.dtype)
    full[tuple(slice(0, s) for s in part.shape)] = part
    raw = full.tobytes()
    raw = zlib.compress(raw) if codec == "zlib" else gzip.compress(raw) if codec == "gzip" else raw
    name = os.path.join(path, ".".join(map(str, chunk)))
    with open(f"{name}.tmp", "wb") as f:
        f.write(raw)
    os.replace(f"{name}.tmp", name)


def write_sharded(path: str, values: np.ndarray, shards: tuple[int, ...], chunks: tuple[int, ...]) -> None:
    """Small writer of version 3 with one level of shards (gzip inside, index at the end, empty chunks left out), for fixtures."""
    os.makedirs(path, exist_ok=True)
    inner = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 1}}]
    sharding = {"chunk_shape": list(chunks), "codecs": inner, "index_codecs": [inner[0]], "index_location": "end"}
    meta = {"zarr_format": 3, "node_type": "array", "shape": list(values.shape), "data_type": values.dtype.name, "fill_value": 0, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(shards)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": [{"name": "sharding_indexed", "configuration": sharding}], "attributes": {}}
    with open(os.path.join(path, "zarr.json"), "w") as f:
        json.dump(meta, f)
    for shard in itertools.product(*[range(-(-s // c)) for s, c in zip(values.shape, shards, strict=True)]):
        full = np.zeros(shards, dtype=values.dtype)
        part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(shard, shards, strict=True))]
        full[tuple(slice(0, s) for s in part.shape)] = part
        body, index = b"", []
        for at in itertools.product(*[range(s // c) for s, c in zip(shards, chunks, strict=True)]):
            block = full[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
            raw = gzip.compress(np.ascontiguousarray(block).tobytes(), 1) if block.any() else b""
            index += [len(body), len(raw)] if raw else [(1 << 64) - 1] * 2
            body += raw
        if body:
            name = os.path.join(path, "c", *map(str, shard))
            os.makedirs(os.path.dirname(name), exist_ok=True)
            with open(f"{name}.tmp", "wb") as f:
                f.write(body + np.array(index, dtype="<u8").tobytes())
            os.replace(f"{name}.tmp", name)
