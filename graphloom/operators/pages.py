"""Tables as sorted pages of arrays in the shared folder, which tasks read with NumPy where joins of rows would fill the disk.

A page is one Parquet file of about PAGE rows. What the driver holds is one row per page. A page of links has all links of
its nodes, so a hub's links are in one page, however many.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import fresh

#: Rows of a page, and links that a task keeps in memory when it comes back to pages.
PAGE, KEPT = 1 << 20, 1 << 26


@dataclass(frozen=True)
class Pages:
    """files: name, first and last key, rows; in the order of keys."""

    folder: str
    files: tuple[tuple[str, int, int, int], ...]

    @property
    def rows(self) -> int:
        return sum(f[3] for f in self.files)

    def read(self, k: int, columns: list[str]) -> dict:
        import pyarrow.fs
        import pyarrow.parquet

        fs, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        table = pyarrow.parquet.read_table(f"{root}/{self.files[k][0]}", columns=columns, filesystem=fs, partitioning=None)
        return {c: table.column(c).to_numpy() for c in columns}


def store(rows: DataFrame, key: str, count: int, name: str, size: int = PAGE) -> Pages:
    """Sorted by the integer column `key`, whose high 32 bits, if it is a packed link, decide on the page."""
    spark, path = rows.sparkSession, fresh(rows.sparkSession, name)
    by = F.shiftright(key, 32) if key == "link" else F.col(key)
    rows.repartitionByRange(max(1, -(-count // size)), by).sortWithinPartitions(key).write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(rows.schema).parquet(path)
    found = read.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min(key).alias("a"), F.max(key).alias("z"), F.count("*").alias("n")).collect()  # a row per page
    return Pages(path, tuple(sorted(((r["f"], r["a"], r["z"], r["n"]) for r in found), key=lambda r: r[1])))


def links(edges: DataFrame, count: int, *more: str) -> Pages:
    """Pages of edges(src, dst) in the order of src and dst, both packed in the long `link`: indices are below 2^31."""
    packed = F.shiftleft(F.col("src").cast("long"), 32).bitwiseOR(F.col("dst").cast("long")).alias("link")
    return store(edges.select(packed, *more), "link", count, "links")


class Links:
    """A page of links in memory: the neighbours of node first + i are dst[at[i]:at[i + 1]]."""

    def __init__(self, pages: Pages, k: int, distinct: bool = False):
        import numpy as np

        link = pages.read(k, ["link"])["link"]
        if distinct:
            link = link[np.concatenate(([True], link[1:] != link[:-1]))]
        src = link >> 32
        self.first, self.last = int(src[0]), int(src[-1])
        self.at = np.concatenate(([0], np.cumsum(np.bincount(src - self.first))))
        self.dst = (link & 0xFFFFFFFF).astype(np.int32)


def spread(starts, counts):
    """Positions starts[i], starts[i] + 1, ... of counts[i] places each, one after the other."""
    import numpy as np

    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Reader:
    """Neighbours of sorted nodes, page by page; the pages used last stay in memory, KEPT links of them."""

    def __init__(self, pages: Pages, distinct: bool = False):
        import numpy as np

        self.pages, self.distinct, self.held, self.size = pages, distinct, OrderedDict(), 0
        self.firsts = np.array([f[1] >> 32 for f in pages.files], np.int64)
        self.lasts = np.array([f[2] >> 32 for f in pages.files], np.int64)

    def page(self, k: int) -> Links:
        if k in self.held:
            self.held.move_to_end(k)
        else:
            while self.held and self.size + self.pages.files[k][3] > KEPT:
                self.size -= self.pages.files[self.held.popitem(last=False)[0]][3]
            self.held[k] = Links(self.pages, k, self.distinct)
            self.size += self.pages.files[k][3]
        return self.held[k]

    def near(self, nodes) -> Iterator[tuple]:
        """Per page: places in nodes, and a neighbour of the node there."""
        import numpy as np

        low, high = np.searchsorted(nodes, self.firsts), np.searchsorted(nodes, self.lasts, "right")
        for k in np.flatnonzero(low < high):
            page, a, z = self.page(int(k)), low[k], high[k]
            here = nodes[a:z] - page.first
            counts = page.at[here + 1] - page.at[here]
            yield np.repeat(np.arange(a, z), counts), page.dst[spread(page.at[here], counts)]


def whole(pages: Pages, n: int, distinct: bool = False):
    """at, dst of all n nodes for one task, four bytes a link."""
    import numpy as np

    counts, dst, end = np.zeros(n + 1, np.int64), np.empty(pages.rows, np.int32), 0
    for k in range(len(pages.files)):
        page = Links(pages, k, distinct)
        dst[end : end + len(page.dst)] = page.dst
        end += len(page.dst)
        counts[page.first + 1 : page.last + 2] = np.diff(page.at)
    return np.cumsum(counts), dst[:end]


def tasks(spark, k: int) -> DataFrame:
    """k partitions of one number each, from 0."""
    return spark.range(0, k, 1, k)


def numbers(batches) -> list[int]:
    return [x for b in batches for x in b.column(0).to_pylist()]


def batches(most: int = 1 << 16, **columns) -> Iterator:
    """Arrays of equal length as Arrow batches."""
    import pyarrow as pa

    size = len(next(iter(columns.values())))
    for a in range(0, size, most):
        yield pa.RecordBatch.from_pydict({k: pa.array(v[a : a + most]) for k, v in columns.items()})
