"""Hash families, duplicate groups and the keep/move plan.

Skew: one hash value (an empty file, a flat image hashing to ``0x0``) may
hold a third of all assets.  Nothing here collects a group: the keeper of
each group is found with a partially aggregated ``min`` over a sort struct
(map-side combine bounds the hot key), then joined back on the group key.
AQE splits the hot partition of that join (``skewJoin``), and when the
number of groups turns out small at runtime it broadcasts the group side.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.functions import hashing
from assetflow.functions.paths import rebase
from assetflow.operators.salting import salted_join

GROUP_KEYS = ("hash_type", "hash")
MIN_GROUP_SIZE = 2  # fixed value: groups with one member are not duplicates


@dataclass(frozen=True)
class HashFamily:
    """A set of hash types computed from one decode, with one keeper order.

    ``build`` returns ``MAP<hash_type, hash>`` from the columns of a frame;
    ``order`` returns ascending Columns (lowest struct = keeper).
    """
    name: str
    hash_types: tuple
    build: Callable[[], Column]
    order: Callable[[], list] = field(default=lambda: [F.col("path")])

    def order_struct(self) -> Column:
        return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(self.order())])


def md5_family(content: str = "content") -> HashFamily:
    return HashFamily(
        name="md5", hash_types=("md5",),
        build=lambda: F.create_map(F.lit("md5"), hashing.content_md5(F.col(content))),
        order=lambda: [F.col("path")])


def phash_family(px: str = "px", height="height", width="width",
                 configs=hashing.PHASH_CONFIGS) -> HashFamily:
    """Perceptual hashes; the keeper is the largest image (w, h, size), then path.

    ``height``/``width`` name columns, or are ints for a fixed-size image set
    (compiled static resize).
    """
    hh = height if isinstance(height, int) else F.col(height)
    ww = width if isinstance(width, int) else F.col(width)
    return HashFamily(
        name="simhash",
        hash_types=tuple(hashing.phash_name(s, b) for s, b in configs),
        build=lambda: hashing.phash_map(px if isinstance(height, int) and isinstance(width, int) else F.col(px),
                                        hh, ww, configs),
        order=lambda: [-F.col("w"), -F.col("h"), -F.col("size"), F.col("path")])


def register_families(*families: HashFamily) -> dict:
    """hash_type -> family; a type registered twice is an error."""
    out = {}
    for fam in families:
        for t in fam.hash_types:
            if t in out:
                raise ValueError(f"hash type {t} already registered")
            out[t] = fam
    return out


def with_hashes(df: DataFrame, *families: HashFamily, col: str = "hashes") -> DataFrame:
    """Add ``MAP<hash_type, hash>`` with every family's types."""
    register_families(*families)
    maps = [fam.build() for fam in families]
    return df.withColumn(col, maps[0] if len(maps) == 1 else F.map_concat(*maps))


def complete_hashes(df: DataFrame, n_types: int, col: str = "hashes") -> DataFrame:
    """Keep assets that have every hash type (a failed hasher leaves gaps)."""
    return df.filter(F.size(col) == n_types)


def hash_long(df: DataFrame, keep=("path", "size", "w", "h"), col: str = "hashes") -> DataFrame:
    """Unpivot the per-asset map into one row per (asset, hash_type).

    ``explode_outer`` plus a null filter gives the same rows as ``explode``
    but stops Catalyst from inferring a ``size(map) > 0`` filter below the
    generator, which would evaluate the (expensive) hash map twice more.
    """
    return (df.select(*keep, F.explode_outer(col).alias("hash_type", "hash"))
            .filter(F.col("hash_type").isNotNull()))


def duplicate_groups(long: DataFrame, family: HashFamily, min_size: int = MIN_GROUP_SIZE) -> DataFrame:
    """One row per group with >= ``min_size`` members: size and keeper.

    ``min`` of the sort struct is partially aggregated, so a hot group costs
    one row per map task before the shuffle.
    """
    fam = long.filter(F.col("hash_type").isin(*family.hash_types))
    extra = [F.col("w").alias("w")] if "w" in long.columns else []
    best = F.min(F.struct(family.order_struct().alias("key"), F.col("path"), *extra)).alias("best")
    out = (fam.groupBy(*GROUP_KEYS)
           .agg(F.count(F.lit(1)).alias("n_members"), best)
           .filter(F.col("n_members") >= min_size))
    keep_w = [F.col("best.w").alias("keep_w")] if extra else []
    return out.select(*GROUP_KEYS, "n_members", F.col("best.path").alias("keep_path"), *keep_w)


def dedup_plan(long: DataFrame, family: HashFamily, dst_root: str | None = None,
               min_size: int = MIN_GROUP_SIZE) -> DataFrame:
    """Every member of every duplicate group with ``keep`` or ``move``.

    The first member in the family's order is kept; the others move under
    ``dst_root`` keeping their relative path (``dst`` = new location; the
    keeper's ``dst`` is its own path); ``member_key`` sorts a group's members in
    the family's order.  Members of a hot group are dealt over
    several tasks; the groups are the small side.
    """
    groups = duplicate_groups(long, family, min_size)
    fam = long.filter(F.col("hash_type").isin(*family.hash_types))
    joined = salted_join(fam, groups, GROUP_KEYS, ["path"])
    keep = F.col("path") == F.col("keep_path")
    dst = F.col("path") if dst_root is None else rebase(F.col("path"), dst_root)
    return joined.select(
        *GROUP_KEYS, "path", "size", "w", "h", "n_members",
        F.when(keep, F.lit("keep")).otherwise(F.lit("move")).alias("action"),
        F.when(keep, F.col("path")).otherwise(dst).alias("dst"), family.order_struct().alias("member_key"),
        *(["keep_w"] if "keep_w" in joined.columns else []))


def scaled_width(plan: DataFrame, cell_width: int = 100) -> DataFrame:
    """Display width relative to the group's keeper: ``int(cell * w / keeper_w)``.

    The keeper's width comes with the plan (chosen in the same aggregate as
    the keeper), so no second pass over the groups is needed.
    """
    return plan.withColumn("width", F.floor(F.lit(cell_width) * F.col("w") / F.col("keep_w")).cast("long"))


def image_phash_family(thumbs: str = "thumbs", configs=hashing.PHASH_CONFIGS) -> HashFamily:
    """Perceptual hashes of decoded images from precomputed thumbnails
    (``functions.thumbnails``): per-pixel work is one vectorised pass per
    image, quantisation and hashing stay native."""
    from assetflow.functions.thumbnails import phash_map_from_thumbs
    return HashFamily(
        name="simhash",
        hash_types=tuple(hashing.phash_name(s, b) for s, b in configs),
        build=lambda: phash_map_from_thumbs(F.col(thumbs), configs),
        order=lambda: [-F.col("w"), -F.col("h"), -F.col("size"), F.col("path")])
