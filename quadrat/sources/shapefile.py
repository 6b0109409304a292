"""ESRI shapefiles: layers by kind and year with filters that reach the files, outlines with attributes
in zip archives, and a writer.

    spark.dataSource.register(ShapefileSource)
    layers(spark, folder).filter("kind = 'city' and year = 2016")

Layers are files `<Cities or Towns>_<year>.shp` under a folder, at any depth.  The filters on kind and year
pick them before any is opened; a file's index (.shx), if there is one, parts it into ranges of records.
The path may be local or of a store that pyarrow knows; of others, read the bytes with Spark's own
reader (`from_bytes`).
"""

from __future__ import annotations

import re
import struct
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.geometry import RINGS
from .files import found, opened

SCHEMA = f"kind string, year int, poly_id bigint, rings {RINGS}, minx double, miny double, maxx double, maxy double"
OUTLINES = f"file string, record bigint, attributes map<string,string>, rings {RINGS}, minx double, miny double, maxx double, maxy double"
POLYGON_TYPES = (5, 15, 25)
#: What files of a kind of layer are called, and the columns that name a country.
FILES = {"Cities": "city", "Towns": "town"}
NAMES = ("ADMIN", "NAME", "SOVEREIGNT")
#: Bytes of a .shp that one task reads.
RANGE = 32 << 20


def polygons_of(data: bytes, at: int = 100) -> Iterator[tuple]:
    """(record number, rings, minx, miny, maxx, maxy) of the polygons in a .shp file's bytes from `at`.

    A record is a big-endian number and length in 16-bit words, then little-endian content: type,
    box, counts of parts and points, where parts start, and points.  Null shapes are skipped.
    """
    while at + 8 <= len(data):
        number, words = struct.unpack_from(">ii", data, at)
        body = at + 8
        at = body + 2 * words
        if at > len(data) or words < 22 or struct.unpack_from("<i", data, body)[0] not in POLYGON_TYPES:
            continue
        minx, miny, maxx, maxy = struct.unpack_from("<4d", data, body + 4)
        parts, points = struct.unpack_from("<2i", data, body + 36)
        starts = [*struct.unpack_from(f"<{parts}i", data, body + 44), points]
        xy = struct.unpack_from(f"<{2 * points}d", data, body + 44 + 4 * parts)
        rings = [[(xy[2 * k], xy[2 * k + 1]) for k in range(a, b)] for a, b in zip(starts, starts[1:])]
        yield number, rings, minx, miny, maxx, maxy


def attributes_of(data: bytes, encoding: str = "utf-8") -> list[dict[str, str]]:
    """Rows of a .dbf file's bytes: a header with the counts of rows and bytes, 32 bytes a field up to a
    carriage return, then rows of fixed width behind a mark; outer blanks don't count."""
    if len(data) < 32:
        return []
    n, header, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at + 32 <= header and data[at] != 13:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), data[at + 16]))
        at += 32
    rows = []
    for k in range(n):
        place, row = header + k * width + 1, {}
        for name, size in fields:
            row[name] = data[place : place + size].decode(encoding, "replace").strip("\0 ")
            place += size
        rows.append(row)
    return rows


def year_in(path: str) -> int | None:
    return next((int(d) for d in re.findall(r"\d+", path.rsplit("/", 1)[-1]) if len(d) == 4), None)


def kind_in(path: str) -> str | None:
    return FILES.get(re.split(r"[_.]", path.rsplit("/", 1)[-1])[0])


@dataclass
class Range(InputPartition):
    path: str
    kind: str | None
    year: int | None
    start: int
    end: int


class ShapefileReader(DataSourceReader):
    """Options: path, a folder or file; kind, for files whose name doesn't say it; bytes, of a task."""

    def __init__(self, options: dict):
        self.path, self.kind, self.bytes = options["path"], options.get("kind"), int(options.get("bytes", RANGE))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in ("kind", "year"):
                values = set(f.value if isinstance(f, In) else [f.value])
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def files(self) -> list[tuple[str, str | None, int | None, int]]:
        """The first file, by path, of each kind and year that is asked for.  To ask for one kind and one
        year that no file has is an error."""
        first: dict[tuple, tuple] = {}
        for path, size in found(self.path, "*.shp"):
            kind, year = self.kind or kind_in(path), year_in(path)
            if kind in self.wanted.get("kind", {kind}) and year in self.wanted.get("year", {year}):
                key = (kind, year) if kind and year else path
                first.setdefault(key, (path, kind, year, size))
        asked = [self.wanted.get(c, ()) for c in ("kind", "year")]
        if not first and all(len(a) == 1 for a in asked):
            raise FileNotFoundError(f"no file of {asked[0]} and {asked[1]} under {self.path}")
        return list(first.values())

    def partitions(self) -> list[Range]:
        out = []
        for path, kind, year, size in self.files():
            index, starts = found(f"{path[:-4]}.shx", "*"), [100]
            if size > self.bytes and index:
                with opened(index[0][0]) as f:
                    places = [2 * x for (x, _) in struct.iter_unpack(">ii", f.read()[100:])]
                for place in places:
                    if place - starts[-1] >= self.bytes:
                        starts.append(place)
            out += [Range(path, kind, year, a, b) for a, b in zip(starts, [*starts[1:], size])]
        return out

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if isinstance(partition, Range) and partition.end > partition.start:
            with opened(partition.path) as f:
                f.seek(partition.start)
                for number, rings, *box in polygons_of(f.read(partition.end - partition.start), 0):
                    yield (partition.kind, partition.year, number, rings, *box)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ShapefileReader(self.options)


def layers(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Polygons of the layers under path; filters on kind and year reach the files."""
    spark.dataSource.register(ShapefileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("shapefile").options(**options).load(path)


class OutlineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        return [InputPartition(p) for pattern in ("*.zip", "*.shp") for p, _ in found(self.path, pattern) if p.endswith(pattern[1:])]

    def read(self, partition):
        if partition is None or not partition.value:
            return
        with opened(partition.value) as f:
            if partition.value.endswith(".zip"):  # members are found by the directory at the archive's end
                with zipfile.ZipFile(f) as z:
                    members = {n.lower(): n for n in z.namelist()}
                    parts = [(members[n], z.read(members[n]), z.read(members[f"{n[:-4]}.dbf"]) if f"{n[:-4]}.dbf" in members else b"") for n in sorted(members) if n.endswith(".shp")]
            else:
                beside = found(f"{partition.value[:-4]}.dbf", "*")
                table = b""
                if beside:
                    with opened(beside[0][0]) as g:
                        table = g.read()
                parts = [(partition.value.rsplit("/", 1)[-1], f.read(), table)]
        for name, shapes, table in parts:
            rows = attributes_of(table)
            for number, rings, *box in polygons_of(shapes):
                yield (name, number, rows[number - 1] if number <= len(rows) else {}, rings, *box)


class OutlineSource(DataSource):
    """Polygons with attributes, of .shp files and zip archives of them; a record of the table belongs to
    the shape of its number."""

    @classmethod
    def name(cls) -> str:
        return "outlines"

    def schema(self) -> str:
        return OUTLINES

    def reader(self, schema) -> DataSourceReader:
        return OutlineReader(self.options)


def outlines(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(OutlineSource)
    return spark.read.format("outlines").load(path)


def outline_name(attributes: Column) -> Column:
    """The value of the first attribute, in the table's own order, that is called ADMIN, NAME or SOVEREIGNT."""
    keys = F.filter(F.map_keys(attributes), lambda k: F.upper(k).isin(*NAMES))
    return F.try_element_at(attributes, F.try_element_at(keys, F.lit(1)))


def of_country(shapes: DataFrame, country: str) -> DataFrame:
    """Outlines whose name is country, in whatever case; signs in it are no patterns."""
    return shapes.filter(F.lower(outline_name(F.col("attributes"))) == F.lower(F.lit(country)))


def from_bytes(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Polygons of the files that match path, in any store that Spark reads."""
    files = spark.read.format("binaryFile").load(path)

    def parse(batches):
        for pdf in batches:
            yield pdf.__class__([(kind, year_in(p), *row) for p, data in zip(pdf["path"], pdf["content"]) for row in polygons_of(data)], columns=["kind", "year", "poly_id", "rings", "minx", "miny", "maxx", "maxy"])

    return files.select("path", "content").mapInPandas(parse, SCHEMA).withColumn("year", F.col("year").cast("int"))


def shape_bytes(shapes: list[list[list[tuple[float, float]]]]) -> tuple[bytes, bytes]:
    """(.shp, .shx) of polygons given by their rings.  A file holds up to 2^31 words; more are an error."""
    def box(points):
        xs, ys = zip(*points) if points else ((0.0,), (0.0,))
        return min(xs), min(ys), max(xs), max(ys)

    bodies, index, words = [], [], 50
    for number, rings in enumerate(shapes, 1):
        points = [tuple(p) for ring in rings for p in ring]
        starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
        body = struct.pack("<i4d2i", 5, *box(points), len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + struct.pack(f"<{2 * len(points)}d", *[v for p in points for v in p])
        bodies.append(struct.pack(">ii", number, len(body) // 2) + body)
        index.append(struct.pack(">ii", words, len(body) // 2))
        words += len(bodies[-1]) // 2
    if words >= 2**31:
        raise ValueError("a shapefile can't be over 4 GB: part the layer")
    whole = box([tuple(p) for rings in shapes for ring in rings for p in ring])
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n) + struct.pack("<2i8d", 1000, 5, *whole, 0, 0, 0, 0)
    return head(words) + b"".join(bodies), head(50 + 4 * len(shapes)) + b"".join(index)


def table_bytes(names: list[str], rows: list[list[str]], width: int = 40) -> bytes:
    """A .dbf of text columns."""
    fields = b"".join(n.encode()[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([width, 0]) + bytes(14) for n in names)
    head = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + len(fields), 1 + width * len(names))
    return head + fields + b"\r" + b"".join(b" " + b"".join(v.encode()[:width].ljust(width) for v in row) for row in rows) + b"\x1a"


def layer_files(polygons: DataFrame) -> DataFrame:
    """`name, content` of a .shp and its .shx for each kind and year, shapes in order of poly_id.  A group is
    one file, whose format bounds it to 4 GB."""
    names = {v: k for k, v in FILES.items()}

    def write(key, pdf):
        pdf = pdf.sort_values("poly_id")
        shp, shx = shape_bytes([[[(p["x"], p["y"]) for p in ring] for ring in rings] for rings in pdf["rings"]])
        stem = f"{names.get(key[0], key[0])}_{key[1]}/{names.get(key[0], key[0])}_{key[1]}"
        return pdf.__class__({"name": [f"{stem}.shp", f"{stem}.shx"], "content": [shp, shx]})

    return polygons.select("kind", "year", "poly_id", "rings").groupBy("kind", "year").applyInPandas(write, "name string, content binary")
