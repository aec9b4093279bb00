"""Volume files as rows: a reader registry, NIfTI-1 and NumPy headers and voxels."""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .mounts import contents

#: Fixed values of the NIfTI-1 format: codes of voxel types.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
HEADER = "path string, shape array<int>, spacing array<double>, dtype string, affine array<double>, affine_hash string, error string"
VOXELS = "path string, x int, y int, z int, value double"


def affine_hash(affine: np.ndarray) -> str:
    """First 16 digits of the SHA-256 of the rounded matrix's bytes."""
    rounded = np.round(np.asarray(affine, np.float64), 6) + 0.0  # no negative zero
    return hashlib.sha256(rounded.tobytes()).hexdigest()[:16]


def _quaternion(b: float, c: float, d: float, offset: tuple, pixdim: tuple) -> np.ndarray:
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    r = np.array(
        [
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ]
    )
    out = np.eye(4)
    out[:3, :3] = r * np.array([pixdim[1], pixdim[2], pixdim[3] * (-1 if pixdim[0] < 0 else 1)])
    out[:3, 3] = offset
    return out


#: Fixed value: where the voxels of a NIfTI-1 file begin at the earliest.
HEADER_BYTES = 352


def _byte_order(data: bytes) -> str:
    end = next((e for e in "<>" if len(data) >= 348 and struct.unpack_from(f"{e}i", data)[0] == 348), None)
    if end is None or data[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    return end


def nifti_header(data: bytes) -> tuple[tuple[int, ...], tuple[float, ...], str, np.ndarray]:
    """(shape, spacing, type of the values, affine) by the first bytes of a NIfTI-1 file."""
    end = _byte_order(data)
    dim, pixdim = struct.unpack_from(f"{end}8h", data, 40), struct.unpack_from(f"{end}8f", data, 76)
    code, scaling = struct.unpack_from(f"{end}h", data, 70)[0], struct.unpack_from(f"{end}2f", data, 112)
    qform, sform = struct.unpack_from(f"{end}2h", data, 252)
    if sform > 0:
        affine = np.vstack([np.array(struct.unpack_from(f"{end}12f", data, 280)).reshape(3, 4), [0, 0, 0, 1]])
    elif qform > 0:
        q = struct.unpack_from(f"{end}6f", data, 256)
        affine = _quaternion(*q[:3], q[3:], pixdim)
    else:
        affine = np.diag([*pixdim[1:4], 1.0])
    stored = np.dtype(NIFTI_TYPES[code])
    scaled = scaling[0] and scaling != (1, 0)
    return tuple(max(1, n) for n in dim[1 : dim[0] + 1]), tuple(pixdim[1 : 1 + min(3, dim[0])]), str(np.result_type(stored, np.float64) if scaled else stored), affine


def read_nifti(data: bytes) -> tuple[np.ndarray, np.ndarray, tuple[float, ...]]:
    """(voxels, affine, spacing) of a NIfTI-1 file, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    end = _byte_order(data)
    shape, spacing, _, affine = nifti_header(data)
    code, start = struct.unpack_from(f"{end}h", data, 70)[0], int(struct.unpack_from(f"{end}f", data, 108)[0])
    slope, inter = struct.unpack_from(f"{end}2f", data, 112)
    values = np.frombuffer(data, f"{end}{NIFTI_TYPES[code]}", int(np.prod(shape)), start).reshape(shape, order="F")
    if slope and (slope, inter) != (1, 0):
        values = values * slope + inter
    return values, affine, spacing


def write_nifti(values: np.ndarray, affine: np.ndarray) -> bytes:
    """A NIfTI-1 file with the affine as sform."""
    code = next(k for k, t in NIFTI_TYPES.items() if np.dtype(t) == values.dtype)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *[1] * (7 - values.ndim))
    struct.pack_into("<2h", head, 70, code, 8 * values.dtype.itemsize)
    struct.pack_into("<8f", head, 76, 1, *np.sqrt((affine[:3, :3] ** 2).sum(axis=0)), 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *np.asarray(affine, float)[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + values.astype(values.dtype.newbyteorder("<")).tobytes(order="F")


def read_numpy(data: bytes) -> tuple[np.ndarray, np.ndarray, tuple[float, ...]]:
    values = np.load(io.BytesIO(data), allow_pickle=False)
    if isinstance(values, np.lib.npyio.NpzFile):
        values = values[values.files[0]]
    return values, np.eye(4), (1.0,) * min(3, values.ndim)


Reader = Callable[[bytes], tuple[np.ndarray, np.ndarray, tuple[float, ...]]]
READERS: dict[str, Reader] = {".nii.gz": read_nifti, ".nii": read_nifti, ".npy": read_numpy, ".npz": read_numpy}


def reader_for(path: str, readers: dict[str, Reader] | None = None) -> Reader:
    """The reader with the longest ending that the path has."""
    known = readers or READERS
    for ending in sorted(known, key=len, reverse=True):
        if path.lower().endswith(ending):
            return known[ending]
    raise ValueError(f"no reader for {path}")


def binary_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    return contents(spark, root, glob)


def headers(files: DataFrame) -> DataFrame:
    """A row per file with shape, spacing, type and affine, or the reason why it can't be read."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    v, affine, spacing = reader_for(path)(content)
                    rows.append((path, list(v.shape), [float(x) for x in spacing], str(v.dtype.newbyteorder("=")), affine.ravel().tolist(), affine_hash(affine), None))
                except Exception as e:  # a broken file is a finding, not a failure
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in HEADER.split(", ")])

    return files.mapInPandas(run, HEADER)


def voxels(files: DataFrame, zeros: bool = False) -> DataFrame:
    """Voxels as rows, without those of value 0 unless asked for."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                v = np.atleast_3d(reader_for(path)(content)[0])
                at = np.argwhere(np.ones(v.shape, bool) if zeros else v != 0)
                for i in range(0, len(at), 1 << 18):
                    a = at[i : i + (1 << 18)]
                    yield pd.DataFrame({"path": path, "x": a[:, 0], "y": a[:, 1], "z": a[:, 2], "value": v[tuple(a.T)].astype(float)})

    return files.mapInPandas(run, VOXELS)


def write_volumes(rows: DataFrame, folder: str) -> None:
    """Write (name, content) to a folder that every executor mounts, a name with its subfolder if it has one; a repeated task replaces its files."""

    def run(part):
        import os

        os.makedirs(folder, exist_ok=True)
        known = {""}
        for r in part:
            below, name = os.path.split(r["name"])
            if below not in known:
                os.makedirs(os.path.join(folder, below), exist_ok=True)
                known.add(below)
            spare = os.path.join(folder, below, f".{name}.part")
            with open(spare, "wb") as f:
                f.write(r["content"])
            os.replace(spare, os.path.join(folder, below, name))

    rows.foreachPartition(run)
