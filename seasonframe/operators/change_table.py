"""A table that takes user changes in any order and in any portions, and rewrites only the parts they touch.

The rows are cut into parts by a hash of their key. Beside each value stands the sequence of the change that wrote it, so
that a change that comes late, or twice, writes only what no later one has written. What a log makes of a table is the
same for every order and every splitting of it:

* the latest non-null value of a column stands; a null keeps what is there;
* a deletion is final, and its row stays as a mark, with its owner and its sequences;
* an insert is known by its sequence and content. Its row has no key of its own yet: on reading, the inserted rows are
  numbered after the greatest key, by sequence and without gaps, and ``seal`` makes those keys lasting. An insert that is
  older than one already sealed comes after it.

A change is rejected unless its owner is the actor, its ``guard`` is null, and the row that it names is there (or
deleted) and the actor's own; inserted rows can be named once they are sealed. Null sequences count as the oldest.
Rows with a null key can be read, not changed. Rejected changes are written below ``rejected``.

A version is named by its parent and the content of the changes that made it: a batch that is run again writes the
same version, and once it has taken effect it changes nothing more. A version is a list of which folder holds which
part; folders of versions that no list names any more are removed.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import discard, materialized, number_rows, written


@dataclass(frozen=True)
class Names:
    """Columns of rows (key, owner) and changes (all but ``parts``, how many parts the rows are cut into)."""

    key: str = "id"
    owner: str = "owner"
    sequence: str = "seq"
    delete: str = "deleted"
    actor: str = "actor"
    guard: str | None = None
    parts: int = 64


_STAMP = "struct<s: bigint, d: bigint>"


def _later(a: Column, b: Column) -> Column:
    """Whether stamp a is later than stamp b; no stamp is the earliest."""
    return a.isNotNull() & (b.isNull() | (a > b))


class ChangeTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        head = spark.read.parquet(f"{self.folder}/versions").orderBy(F.desc("number")).select("number", "version", "top", "names", "schema").first()
        self.number, self.version, self.top = head["number"], head["version"], head["top"]
        self.names = Names(**json.loads(head["names"]))
        self.schema = T.StructType.fromJson(json.loads(head["schema"]))

    @classmethod
    def create(cls, rows: DataFrame, folder: str, **names) -> ChangeTable:
        """Write the first version: the rows as they are."""
        n, folder, spark = Names(**names), folder.rstrip("/"), rows.sparkSession
        discard(spark, folder)
        made = object.__new__(cls)
        made.spark, made.folder, made.names, made.schema = spark, folder, n, rows.schema
        made.number, made.version = -1, ""
        made.top = rows.agg(F.coalesce(F.max(n.key), F.lit(0)).cast("long")).first()[0]
        made._commit(made._stated(rows, F.lit(None).cast("long"), F.lit(None).cast("long")), "created", {}, made.top)
        return cls(spark, folder)

    # --- how rows are kept

    @property
    def data(self) -> list[str]:
        return [c for c in self.schema.names if c != self.names.key]

    def _part(self) -> Column:
        """Rows with a key by it, inserted rows by what they are known by."""
        n = self.names.parts
        return F.when(F.col("__seq").isNull(), F.pmod(F.xxhash64(self.names.key), F.lit(n))).otherwise(n + F.pmod(F.xxhash64("__seq", "__digest"), F.lit(n))).cast("int")

    def _stated(self, rows: DataFrame, seq: Column, digest: Column) -> DataFrame:
        stamps = F.struct(*[F.lit(None).cast(_STAMP).alias(c) for c in self.data])
        return rows.select(*self.schema.names, seq.alias("__seq"), digest.alias("__digest"), F.lit(False).alias("__gone"), stamps.alias("__stamps")).withColumn("__part", self._part())

    @property
    def _state_schema(self) -> T.StructType:
        stamps = ", ".join(f"`{c}`: {_STAMP}" for c in self.data)
        more = T._parse_datatype_string(f"__seq long, __digest long, __gone boolean, __stamps struct<{stamps}>, __part int")
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in self.schema.fields] + more.fields)

    def held(self) -> dict[int, str]:
        """Which version's folder holds each part; as many as there are parts."""
        rows = self.spark.read.parquet(f"{self.folder}/versions").filter(F.col("number") == self.number).select(F.explode_outer("held").alias("h")).select("h.*").collect()
        return {r["part"]: r["version"] for r in rows if r["part"] is not None}

    def _state(self, parts: list[int] | None = None) -> DataFrame:
        held = self.held()
        paths = [f"{self.folder}/data/version={v}/__part={p}" for p, v in sorted(held.items()) if parts is None or p in parts]
        if not paths:
            return self.spark.createDataFrame([], self._state_schema)
        return self.spark.read.schema(self._state_schema).option("basePath", f"{self.folder}/data").parquet(*paths).select(*self._state_schema.names)

    def _commit(self, state: DataFrame, content: str, held: dict[int, str], top: int) -> None:
        """Write the parts in ``state`` as a new version; all others stay where they are."""
        version = hashlib.sha256(f"{self.version}/{content}".encode()).hexdigest()[:24]
        made = written(state.repartition("__part"), f"{self.folder}/data/version={version}", ["__part"])
        held = held | {r["__part"]: version for r in made.select("__part").distinct().collect()}
        row = [(version, top, json.dumps(asdict(self.names)), self.schema.json(), sorted(held.items()))]
        schema = "version string, top long, names string, schema string, held array<struct<part: int, version: string>>"
        self.spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/number={self.number + 1}")

    # --- reading

    def read(self) -> DataFrame:
        """The rows as they are now; inserted ones have the keys that ``seal`` would give them."""
        state = self._state().filter(~F.col("__gone"))
        kept = state.filter(F.col("__seq").isNull()).select(*self.schema.names)
        key = self.names.key
        new = number_rows(state.filter(F.col("__seq").isNotNull()), ["__seq", "__digest"], "__number")
        new = new.withColumn(key, (F.lit(self.top) + F.col("__number")).cast(self.schema[key].dataType))
        return kept.unionByName(new.select(*self.schema.names))

    # --- changes

    def _prepared(self, batch: DataFrame) -> DataFrame:
        """Each change once, with its stamp and whether it is the actor's to make."""
        n = self.names
        allowed = F.coalesce(F.col(n.owner) == F.col(n.actor), F.lit(False))
        if n.guard is not None and n.guard in batch.columns:
            allowed = allowed & F.col(n.guard).isNull()
        order = F.coalesce(F.col(n.sequence).cast("long"), F.lit(-(1 << 63)))
        out = batch.select("*", F.xxhash64(F.to_json(F.struct(*sorted(batch.columns)))).alias("__d"), order.alias("__s"), allowed.alias("__allowed"), F.coalesce(F.col(n.delete), F.lit(False)).alias("__delete"))
        return out.dropDuplicates(["__s", "__d"]).withColumn("__stamp", F.struct(F.col("__s").alias("s"), F.col("__d").alias("d")))

    def apply(self, batch: DataFrame) -> dict[str, int]:
        """Apply a portion of a log: how many of its changes were ``applied``, ``stale`` (late, or there before), ``rejected``."""
        n, key = self.names, self.names.key
        changes = materialized(self._prepared(batch))
        sent = [c for c in self.data if c in batch.columns and c != n.owner]
        insert = F.col(key).isNull() & ~F.col("__delete")
        place = changes.filter("__allowed").select(F.when(insert, F.col("__s")).alias("__seq"), F.when(insert, F.col("__d")).alias("__digest"), key)
        parts = [r[0] for r in place.select(self._part()).distinct().collect()]
        state = self._state(parts)
        base, inserts = state.filter(F.col("__seq").isNull()), state.filter(F.col("__seq").isNotNull())
        # what each change finds
        there = base.select(F.col(key).alias("__k"), F.col(n.owner).alias("__owner"), F.col("__gone").alias("__was"), F.col("__stamps").alias("__old"))
        before = inserts.select(F.col("__seq").alias("__is"), F.col("__digest").alias("__id"))
        judged = changes.join(there, F.col(key) == F.col("__k"), "left").join(before, insert & (F.col("__s") == F.col("__is")) & (F.col("__d") == F.col("__id")), "left")
        named = F.col("__allowed") & F.coalesce(F.col("__owner") == F.col(n.actor), F.lit(False))
        fine = F.when(insert, F.col("__allowed")).otherwise(named)
        writes = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & _later(F.col("__stamp"), F.col("__old")[c]) for c in sent], F.lit(False))
        new = F.when(insert, F.col("__is").isNull()).when(F.col("__was"), F.lit(False)).when(F.col("__delete"), F.lit(True)).otherwise(writes)
        judged = materialized(judged.withColumn("__fate", F.when(~fine, "rejected").when(new, "applied").otherwise("stale")).drop("__k", "__owner", "__was", "__old", "__is", "__id"))
        counts = {"applied": 0, "stale": 0, "rejected": 0} | {r["__fate"]: r["count"] for r in judged.groupBy("__fate").count().collect()}
        digest = changes.agg(F.count("*"), F.sum(F.xxhash64("__s", "__d").cast("decimal(38,0)"))).first()
        content = f"{digest[0]}/{digest[1]}"
        if counts["rejected"]:
            name = hashlib.sha256(content.encode()).hexdigest()[:24]
            judged.filter("__fate = 'rejected'").select(*batch.columns).write.mode("overwrite").parquet(f"{self.folder}/rejected/batch={name}")
        if not counts["applied"]:
            return counts
        fresh = judged.filter("__fate = 'applied'")
        # the latest value of each column, the rows of a key combined before they are shuffled
        latest = [F.max_by(F.struct(F.col(c).alias("v"), F.col("__stamp").alias("at")), F.when(F.col(c).isNotNull() & ~F.col("__delete"), F.col("__stamp"))).alias(f"__new_{c}") for c in sent]
        merged = fresh.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.bool_or("__delete").alias("__deleted"), *latest)
        joined = base.join(merged, F.col(key) == F.col("__k"), "left")
        newer = {c: _later(F.col(f"__new_{c}.at"), F.col(f"__stamps.{c}")) for c in sent}
        rows = [F.when(newer[c], F.col(f"__new_{c}.v").cast(self.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in sent else F.col(c) for c in self.schema.names]
        stamps = F.struct(*[(F.when(newer[c], F.col(f"__new_{c}.at")).otherwise(F.col(f"__stamps.{c}")) if c in sent else F.col(f"__stamps.{c}")).alias(c) for c in self.data])
        updated = joined.select(*rows, "__seq", "__digest", (F.col("__gone") | F.coalesce("__deleted", F.lit(False))).alias("__gone"), stamps.alias("__stamps"), "__part")
        added = fresh.filter(insert).select(*[F.col(c).cast(self.schema[c].dataType).alias(c) if c in batch.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.schema.names], F.col("__s"), F.col("__d"))
        added = self._stated(added, F.col("__s"), F.col("__d"))
        self._commit(updated.unionByName(inserts).unionByName(added), content, self.held(), self.top)
        self.__init__(self.spark, self.folder)
        return counts

    def seal(self) -> int:
        """Give the inserted rows lasting keys; how many there were. What they are known by stays, as a mark."""
        n = self.names
        state = self._state(list(range(n.parts, 2 * n.parts)))
        new = materialized(number_rows(state.filter(~F.col("__gone")), ["__seq", "__digest"], "__number"))
        count = new.count()
        if not count:
            return 0
        new = new.withColumn(n.key, (F.lit(self.top) + F.col("__number")).cast(self.schema[n.key].dataType)).drop("__number")
        rows = self._stated(new, F.lit(None).cast("long"), F.lit(None).cast("long"))
        marks = new.withColumn("__gone", F.lit(True)).unionByName(state.filter("__gone"))
        parts = [r[0] for r in rows.select("__part").distinct().collect()]
        self._commit(self._state(parts).unionByName(rows).unionByName(marks), "sealed", self.held(), self.top + count)
        self.__init__(self.spark, self.folder)
        return count

    def clear(self, keep: int = 2) -> None:
        """Remove the folders that the last ``keep`` versions don't name, and the lists of those before them."""
        versions = self.spark.read.parquet(f"{self.folder}/versions")
        lists = versions.select("number", "version", F.expr("transform(held, h -> h.version)").alias("held")).collect()
        last = sorted(lists, key=lambda r: -r["number"])[:keep]
        named = {v for r in last for v in r["held"]}
        for r in lists:
            if r["number"] not in {x["number"] for x in last}:
                for v in {r["version"], *r["held"]} - named:
                    discard(self.spark, f"{self.folder}/data/version={v}")
                discard(self.spark, f"{self.folder}/versions/number={r['number']}")
