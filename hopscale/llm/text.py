"""Column expressions on texts that several operators share; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopscale.scratch import small

#: Runs of ASCII white space; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once.

    Spark may move a column's expression into a lambda that mentions the column, and a filter on the
    result moves it there for certain; it would then be evaluated for every element. A lambda's own
    variable is bound to a value and cannot be moved.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: str | Column) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def space_words(text: str | Column) -> Column:
    """array<string> of words between ASCII white space."""
    return F.array_remove(F.split(whole(text), SPACE, -1), "")


def n_space_words(text: str | Column) -> Column:
    """Number of those words, as long."""
    return F.size(space_words(text)).cast("long")


def uniform(*cols: str | Column, seed: int) -> Column:
    """A double strictly between 0 and 1 that depends on the columns and the seed only."""
    h = F.xxhash64(*cols, F.lit(seed))
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / F.lit(float(2**52))


def free(name: str, *frames: DataFrame) -> str:
    """name, with underscores added until no frame has a column of that name."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs without the rows whose id and text are in gone: (id, xxhash64 of the text), a written table. It is broadcast if counted to be small."""
    i, k = free("_i", docs), free("_k", docs)
    gone = small(gone).toDF(i, k)
    return docs.join(gone, F.col(doc_id).cast(gone.schema[i].dataType).eqNullSafe(F.col(i)) & (F.xxhash64(whole(text)) == F.col(k)), "left_anti")
