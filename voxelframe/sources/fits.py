"""FITS binary tables: a Spark data source for reading and a plain writer for fixtures.

Format per the FITS standard 4.0: 2880-byte blocks, 80-character header cards,
big-endian rows of fixed width. Columns of L, B, I, J, K, E, D are read, as
arrays where a cell holds several values, and nA as text; others raise. Scaled
columns (TSCAL, TZERO) come out as physical values, unsigned integers as the next
wider type, and integers equal to TNULL, undefined logicals as null.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxelframe.session import ship_package

BLOCK, CARD = 2880, 80
#: Fixed values of the standard: code -> (numpy type, Spark type).
CODES = {"L": ("S1", T.BooleanType()), "B": ("u1", T.ShortType()), "I": (">i2", T.ShortType()), "J": (">i4", T.IntegerType()), "K": (">i8", T.LongType()), "E": (">f4", T.FloatType()), "D": (">f8", T.DoubleType())}
#: Fixed values of the standard: code -> TZERO that stands for the other signedness, and the Spark type that then holds the values.
UNSIGNED = {"B": (-128, T.ShortType()), "I": (2**15, T.IntegerType()), "J": (2**31, T.LongType()), "K": (2**63, T.DecimalType(20, 0))}
ROWS_PER_TASK = 1_000_000
BATCH_BYTES = 8 << 20  # of the file, read at a time


def _open(path: str):
    """A random-access file by local path or URI."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def _header(f) -> dict[str, str] | None:
    cards: dict[str, str] = {}
    while True:
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            return cards or None
        for k in range(0, BLOCK, CARD):
            card = block[k : k + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards
            if card[8:10] == "= ":
                value = card[10:].strip()
                cards[key] = value[1:].split("'")[0].rstrip() if value.startswith("'") else value.split("/")[0].strip()


def _blocks(n: int) -> int:
    return -(-n // BLOCK) * BLOCK


def describe(path: str, hdu: int = 1) -> dict:
    """Where the rows of a binary table start, and its row type."""
    with _open(path) as f:
        for k in range(hdu + 1):
            h = _header(f)
            if h is None:
                raise ValueError(f"{path} has no HDU {hdu}")
            axes = [int(h[f"NAXIS{i + 1}"]) for i in range(int(h.get("NAXIS", 0)))]
            size = abs(int(h.get("BITPIX", 8))) // 8 * int(np.prod(axes)) + int(h.get("PCOUNT", 0)) if axes else 0
            if k == hdu:
                break
            f.seek(f.tell() + _blocks(size))
        if h.get("XTENSION") != "BINTABLE":
            raise ValueError(f"HDU {hdu} of {path} is not a binary table")
        columns = [_column(h, i) for i in range(1, int(h["TFIELDS"]) + 1)]
        offset = 0
        for c in columns:
            c["offset"] = offset
            offset += c["bytes"]
        return {"start": f.tell(), "rows": axes[1], "width": axes[0], "columns": columns, "schema": T.StructType([T.StructField(c["name"], c["type"]) for c in columns])}


def _column(h: Mapping[str, str], i: int) -> dict:
    """Name, place and meaning of the i-th column."""
    form, name = h[f"TFORM{i}"].strip(), h.get(f"TTYPE{i}", f"col{i}")
    digits = len(form) - len(form.lstrip("0123456789"))
    count, code = int(form[:digits] or 1), form[digits : digits + 1]
    scale, zero, null = float(h.get(f"TSCAL{i}", 1)), h.get(f"TZERO{i}", "0"), h.get(f"TNULL{i}")
    if code == "A":
        return {"name": name, "code": "A", "count": count, "bytes": count, "numpy": f"S{count}", "type": T.StringType()}
    if code not in CODES or form[digits + 1 :]:
        raise ValueError(f"column {name}: format {form!r} is not supported")
    numpy, kind = CODES[code]
    shift = float(zero)
    unsigned = code in UNSIGNED and scale == 1 and shift == UNSIGNED[code][0]
    scaled = (scale != 1 or shift != 0) and not unsigned and code != "L"
    if unsigned:
        kind = UNSIGNED[code][1]
    elif scaled:
        kind = T.DoubleType()
    out = {"name": name, "code": code, "count": count, "bytes": count * np.dtype(numpy).itemsize, "numpy": numpy, "cell": kind, "type": kind if count == 1 else T.ArrayType(kind)}
    return out | {"unsigned": unsigned, "scale": scale if scaled else None, "zero": shift, "null": int(null) if null is not None and code in UNSIGNED else None}


def _values(flat: np.ndarray, c: dict) -> pa.Array:
    """Physical values of raw ones, in a row."""
    if c["code"] == "L":
        return pa.array(flat == b"T", mask=(flat != b"T") & (flat != b"F"))
    missing = None if c["null"] is None else flat == c["null"]
    if c["unsigned"]:
        if c["code"] == "K":  # beyond a signed LONG
            wide = [None if v is None else Decimal(v) for v in pa.array(flat.astype("i8") ^ np.int64(-(2**63)), mask=missing).cast(pa.int64()).to_pylist()]
            return pa.array([None if v is None else v + 2**64 if v < 0 else v for v in wide], pa.decimal128(20, 0))
        return pa.array((flat.astype("i8") + int(c["zero"])).astype({"B": "i2", "I": "i4", "J": "i8"}[c["code"]]), mask=missing)
    if c["scale"] is not None:
        return pa.array(flat.astype("f8") * c["scale"] + c["zero"], mask=missing)
    return pa.array(flat.astype({T.ShortType: "i2", T.IntegerType: "i4", T.LongType: "i8", T.FloatType: "f4", T.DoubleType: "f8"}[type(c["cell"])]), mask=missing)


def _arrow(rows: np.ndarray, c: dict) -> pa.Array:
    """A column of raw rows (bytes by width)."""
    raw = np.ascontiguousarray(rows[:, c["offset"] : c["offset"] + c["bytes"]])
    if c["code"] == "A":
        texts = raw.view(f"S{c['count']}").ravel().tolist() if c["count"] else [b""] * len(rows)
        return pa.array([v.split(b"\0")[0].decode("ascii", "replace").rstrip() for v in texts], pa.string())
    flat = _values(raw.view(c["numpy"]).ravel(), c)
    if c["count"] == 1:
        return flat
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype="i4") * c["count"]), flat)


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class _FitsReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], names: Sequence[str]):
        self.paths, self.hdu, self.names = options["path"].split(","), int(options.get("hdu", 1)), list(names)
        self.step = int(options.get("rowspertask", ROWS_PER_TASK))

    def partitions(self) -> Sequence[InputPartition]:
        return [_Rows(p, k, min(self.step, n - k)) for p in self.paths for n in [describe(p, self.hdu)["rows"]] for k in range(0, max(n, 1), self.step)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        d = describe(part.path, self.hdu)
        by_name = {c["name"]: c for c in d["columns"]}
        columns = [by_name[n] for n in self.names]
        many = max(1, BATCH_BYTES // max(d["width"], 1))
        with _open(part.path) as f:
            f.seek(d["start"] + part.first * d["width"])
            for k in range(0, part.count, many):
                n = min(many, part.count - k)
                rows = np.frombuffer(f.read(n * d["width"]), dtype="u1").reshape(n, d["width"])
                yield pa.RecordBatch.from_arrays([_arrow(rows, c) for c in columns], names=self.names)


class FitsDataSource(DataSource):
    """``spark.read.format("fits").option("hdu", 1).load(path)``; tasks read disjoint row ranges.

    Only the columns of the table's schema are decoded: name the ones wanted with
    ``.option("columns", "x,y,z")``.
    """

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> T.StructType:
        whole = describe(self.options["path"].split(",")[0], int(self.options.get("hdu", 1)))["schema"]
        wanted = self.options.get("columns")
        return whole if not wanted else T.StructType([whole[n.strip()] for n in wanted.split(",")])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FitsReader(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(FitsDataSource)


def _cards(pairs: Sequence[tuple[str, object]]) -> bytes:
    text = ""
    for key, value in pairs:
        shown = f"'{value:<8}'" if isinstance(value, str) and value not in ("T", "F") else f"{value!s:>20}"
        text += f"{key:<8}= {shown}".ljust(CARD)
    text += "END".ljust(CARD)
    return text.ljust(_blocks(len(text))).encode("ascii")


def write_fits(path: str, columns: Mapping[str, np.ndarray], cards: Sequence[tuple[str, object]] = ()) -> None:
    """Write columns (numbers, logicals as ``S1``, text as ``Sn``; a row of several values where two-dimensional) as one binary table, with further header cards such as ``("TSCAL1", 0.5)``."""
    codes = {"u1": "B", "i2": "I", "i4": "J", "i8": "K", "f4": "E", "f8": "D", "S1": "L"}
    arrays = {n: np.asarray(v) for n, v in columns.items()}
    code = {n: codes.get(a.dtype.str[1:], "A") for n, a in arrays.items()}
    forms = {n: f"{a.dtype.itemsize}A" if code[n] == "A" else f"{a.shape[1] if a.ndim > 1 else ''}{code[n]}" for n, a in arrays.items()}
    rows = np.empty(len(next(iter(arrays.values()))), dtype=[(n, a.dtype if code[n] == "A" else CODES[code[n]][0], a.shape[1:]) for n, a in arrays.items()])
    for n, a in arrays.items():
        rows[n] = a
    data = rows.tobytes()
    head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.dtype.itemsize), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(arrays))]
    for i, n in enumerate(arrays, 1):
        head += [(f"TTYPE{i}", n), (f"TFORM{i}", forms[n])]
    head += list(cards)
    with open(path, "wb") as f:
        f.write(_cards([("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", "T")]))
        f.write(_cards(head))
        f.write(data.ljust(_blocks(len(data)), b"\0"))
