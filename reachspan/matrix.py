"""The Boolean sparse matrix: a relation of cells or of column intervals, and its shape."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "rank long, id long, name string, len long"
EDGES = "src long, dst long"
PATHS = "name string, pos int, node long"
PAIRS = "i long, j long"
COLUMNS = {"basic": ["row", "col"], "ranges": ["row", "lo", "hi"]}


#: A bound up to this is taken for the most cells of a row.
TRUSTED = 1 << 12


@dataclass(frozen=True)
class Sizes:
    """Entries and their cells, the longest entry, the most entries and the most cells of one row (or bounds of them), and entries that touch the diagonal."""

    entries: int
    cells: int
    longest: int
    fullest: int
    widest: int
    touching: int = 0

    @property
    def mean(self) -> float:
        """Cells of an average entry."""
        return self.cells / self.entries if self.entries else 0.0


@dataclass(frozen=True)
class BoolMatrix:
    """`df` holds distinct cells (row, col), or canonical intervals (row, lo, hi), hi included: sorted apart and never adjacent.

    The relation does not show empty rows, so the shape is kept beside it.
    """

    df: DataFrame
    nrows: int
    ncols: int
    encoding: str
    #: Whether the entries stand on disk, and what is known of them.
    held: bool = field(default=False, compare=False)
    sizes: Sizes | None = field(default=None, compare=False)
    #: The most cells that a row can have, and the same matrix as canonical intervals, where they are known without work.
    bound: int | None = field(default=None, compare=False)
    ranges: DataFrame | None = field(default=None, compare=False)
    #: What was made of it and stands on disk: itself, with the diagonal, and its squares.
    known: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        if self.encoding not in COLUMNS:
            raise ValueError(f"unknown encoding {self.encoding!r}")
        if self.nrows < 0 or self.ncols < 0:
            raise ValueError("a shape is not negative")
        object.__setattr__(self, "df", self.df.select(*(F.col(c).cast("long").alias(c) for c in COLUMNS[self.encoding])))

    @property
    def shape(self) -> tuple[int, int]:
        return self.nrows, self.ncols

    def with_df(self, df: DataFrame, encoding: str | None = None) -> BoolMatrix:
        return BoolMatrix(df, self.nrows, self.ncols, encoding or self.encoding)

    def measured(self) -> Sizes:
        """Its sizes, by an aggregate over rows; kept if the entries stand on disk.  A small `bound` stands for the most of one row, so that no row is shuffled."""
        if self.sizes is not None:
            return self.sizes
        lo, hi = ("col", "col") if self.encoding == "basic" else ("lo", "hi")
        length = F.col(hi) - F.col(lo) + 1
        near = F.count_if((F.col(lo) <= F.col("row") + 1) & (F.col(hi) >= F.col("row") - 1))
        if self.bound is not None and self.bound <= TRUSTED:
            total = self.df.agg(F.count("*"), F.sum(length), F.max(length), near).first()
            found = Sizes(total[0], total[1] or 0, total[2] or 0, min(self.bound, total[0]), min(self.bound, total[1] or 0), total[3])
            if self.held:
                object.__setattr__(self, "sizes", found)
            return found
        rows = self.df.groupBy("row").agg(F.count("*").alias("n"), F.sum(length).alias("cells"), F.max(length).alias("longest"), near.alias("near"))
        found = Sizes(*(x or 0 for x in rows.agg(F.sum("n"), F.sum("cells"), F.max("longest"), F.max("n"), F.max("cells"), F.sum("near")).first()))
        if self.held:
            object.__setattr__(self, "sizes", found)
        return found

    def nnz(self) -> int:
        """Number of true cells."""
        from reachspan.functions.ranges import nnz

        return nnz(self).first().nnz

    def to_basic(self) -> BoolMatrix:
        from reachspan.functions.ranges import to_basic

        return self if self.encoding == "basic" else BoolMatrix(to_basic(self.df), self.nrows, self.ncols, "basic", bound=self.bound)

    def to_ranges(self) -> BoolMatrix:
        from reachspan.functions.ranges import to_ranges

        if self.encoding == "ranges":
            return self
        df = self.ranges if self.ranges is not None else to_ranges(self.df, self.most_cells())
        return BoolMatrix(df, self.nrows, self.ncols, "ranges", bound=self.bound)

    def most_cells(self) -> int:
        """The most cells that a row can have, as far as known without work."""
        return min(x for x in (self.ncols, self.sizes and self.sizes.widest, self.bound) if x is not None)

    def most_entries(self) -> int:
        """The most entries that a row can have, as far as known without work."""
        return min(self.most_cells(), self.sizes.fullest) if self.sizes else self.most_cells()

    def cached(self, level: str = "MEMORY_AND_DISK") -> BoolMatrix:
        """Persisted at a storage level of Spark: what the buffered and in-core kinds of a matrix are here."""
        from pyspark import StorageLevel

        return self.with_df(self.df.persist(getattr(StorageLevel, level)))

    def equals(self, other: BoolMatrix) -> bool:
        """Equal shape and cells."""
        a, b = self.to_ranges(), other.to_ranges()
        if a.shape != b.shape:
            return False
        # canonical intervals occur once on a side: an interval of both cancels out, in one shuffle
        sides = a.df.withColumn("_side", F.lit(1)).unionByName(b.df.withColumn("_side", F.lit(-1)))
        return sides.groupBy("row", "lo", "hi").agg(F.sum("_side").alias("_side")).where("_side <> 0").isEmpty()
