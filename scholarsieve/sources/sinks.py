"""Where results go: versioned state tables, immutable snapshots, exports and reports."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from scholarsieve.functions.text import html_escape


POINTER = "POINTER-"
SMALL_CHANGES = 4 << 20  # bytes as stored


class Conflict(RuntimeError):
    """An immutable snapshot was about to change, or another writer holds the store."""


class Store:
    """Tables of one deployment under a root folder on any Hadoop file system.

    Every write goes to a fresh version folder; a numbered pointer file is then created
    beside the older ones. The newest complete pointer wins, nothing is deleted or
    replaced, so readers, retried tasks and crashes between the steps never see half a
    table or an empty one.

    A pointer names a base version and the changes made since, oldest first: `change` writes
    only changed rows, reading takes the newest row of each key, and `compact` makes one base
    of them. It may also carry notes (a cursor), which so become visible together with the rows.
    """

    FORMAT = "1"

    def __init__(self, spark: SparkSession, root: str, publisher=None):
        self.spark, self.root, self.publisher = spark, root.rstrip("/"), publisher
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = self._read_text(f"{self.root}/FORMAT")
        if found is None:
            self._write_text(f"{self.root}/FORMAT", self.FORMAT)
        elif found.strip() != self.FORMAT:
            # Never rewritten: the files stay as they are for inspection.
            raise Conflict("state_corrupt: unsupported format")

    def _read_text(self, path: str) -> str | None:
        if not self._fs.exists(self._path(path)):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, path: str, content: str, overwrite: bool = True) -> None:
        stream = self._fs.create(self._path(path), overwrite)
        try:
            stream.write(bytearray(content.encode("utf-8")))
        finally:
            stream.close()

    def _swap(self, path: str, content: str) -> None:
        """Replace a small file in one step; readers see the old or the new one."""
        jvm, configuration = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        target = self._fs.makeQualified(self._path(path))
        staged = self._fs.makeQualified(self._path(f"{path}.{uuid.uuid4().hex}"))
        self._write_text(staged.toString(), content)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), configuration).rename(staged, target, options)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _pointer(self, table: str) -> tuple[int, dict | None]:
        """Highest pointer number and what the newest complete pointer holds: versions (base first), keys, notes."""
        numbers = sorted((int(n[len(POINTER):]) for n in self._names(f"{self.root}/{table}") if n.startswith(POINTER)), reverse=True)
        for number in numbers:
            version = self._read_text(f"{self.root}/{table}/{POINTER}{number:012d}")
            if version and version.endswith("\n"):  # a pointer cut off while it was written lacks its end
                held = version.strip()  # a bare version name is a table without changes
                return numbers[0], json.loads(held) if held.startswith("{") else {"versions": [held], "keys": [], "notes": {}}
        return (numbers or [0])[0], None

    def _publish(self, table: str, df: DataFrame, make) -> DataFrame:
        """Write a version folder, then a pointer made of the current one; returns the table."""
        number, held = self._pointer(table)
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{table}/{version}")
        made = make(held or {"versions": [], "keys": [], "notes": {}}, version)
        known = self.load(table).schema if len(made["versions"]) > 1 else T.StructType([])
        fields = [*known, *(f for f in df.schema if f.name not in known.names)]
        pointer = json.dumps({**made, "schema": T.StructType(fields).jsonValue()}, sort_keys=True)
        # Creating fails if another writer has taken the number meanwhile.
        self._write_text(f"{self.root}/{table}/{POINTER}{number + 1:012d}", pointer + "\n", overwrite=False)
        if self.publisher is not None:
            try:
                self.publisher(table, version)
            except Exception as exc:
                raise Conflict(f"checkpoint_publish_failed:{type(exc).__name__}") from None
        return self.load(table)

    def save(self, table: str, df: DataFrame, notes: dict | None = None) -> DataFrame:
        """Write a new base version and point at it; returns the stored table. Notes stay unless new ones are given."""
        return self._publish(table, df, lambda held, version: {
            "versions": [version], "keys": [], "notes": held["notes"] if notes is None else notes})

    def change(self, table: str, df: DataFrame, *keys: str, notes: dict | None = None) -> DataFrame:
        """Add rows that replace those with the same keys (one row per key in `df`); the rest of the table is not written."""
        def added(held, version):
            if held["keys"] and tuple(held["keys"]) != keys:
                raise Conflict(f"state_corrupt: {table} is keyed by {held['keys']}")
            return {"versions": [*held["versions"], version], "keys": list(keys), "notes": held["notes"] if notes is None else notes}

        return self._publish(table, df, added)

    def compact(self, table: str) -> DataFrame | None:
        """One base version of a table with changes; without any, nothing is written."""
        _, held = self._pointer(table)
        return self.load(table) if held is None or len(held["versions"]) < 2 else self.save(table, self.load(table))

    def notes(self, table: str) -> dict:
        """What was last noted with the table's rows."""
        _, held = self._pointer(table)
        return dict(held["notes"]) if held else {}

    def load(self, table: str) -> DataFrame | None:
        """The newest rows; None only for a table that was never written."""
        _, held = self._pointer(table)
        if held is None:
            if self._names(f"{self.root}/{table}"):
                raise Conflict(f"state_corrupt: {table} has versions but no pointer")
            return None
        base, *changes = (f"{self.root}/{table}/{version}" for version in held["versions"])
        # Columns that a version did not store are null.
        reader = self.spark.read.schema(T.StructType.fromJson(held["schema"])) if "schema" in held else self.spark.read
        if not changes:
            return reader.parquet(base)
        size = sum(self._fs.getContentSummary(self._path(path)).getLength() for path in changes)
        order = {version: i for i, version in enumerate(held["versions"][1:])}
        return newest(reader.parquet(base), reader.parquet(*changes), order, held["keys"], small=size <= SMALL_CHANGES)

    def append(self, log: str, df: DataFrame) -> None:
        """Add rows to a log; the file committer makes each append all or nothing."""
        df.write.mode("append").parquet(f"{self.root}/{log}.log")

    def append_once(self, log: str, df: DataFrame, schema: str, *keys: str, within: Column | None = None) -> None:
        """Add the rows whose keys the log does not hold yet, so that a repeated stage adds nothing.

        `within` narrows the rows of the log that are looked at, such as those of one run.
        """
        held = self.log(log, schema)
        held = (held if within is None else held.where(within)).select(*keys).distinct()
        self.append(log, df.dropDuplicates(list(keys)).join(held, list(keys), "left_anti").select(*(c.name for c in self.spark.createDataFrame([], schema).schema)))

    def claim(self, name: str) -> bool:
        """Take a name for good; of several claimants exactly one is told yes."""
        path = self._path(f"{self.root}/claims/{name}")
        self._fs.mkdirs(path.getParent())
        return self._fs.createNewFile(path)

    def log(self, log: str, schema: str) -> DataFrame:
        """All rows of a log; success markers play no part, they may be switched off."""
        path = f"{self.root}/{log}.log"
        if not any(not name.startswith(("_", ".")) for name in self._names(path)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def lock(self) -> None:
        path = self._path(f"{self.root}/.run.lock")
        if not self._fs.createNewFile(path):
            raise Conflict("state_locked")

    def unlock(self) -> None:
        self._fs.delete(self._path(f"{self.root}/.run.lock"), False)

    def snapshot(self, relative: str, lines: DataFrame, sort: list[str]) -> None:
        """Write ordered lines once; writing the same content again is fine, other content is a conflict.

        The content hash is an order-independent sum of row hashes computed on the cluster.
        """
        keyed = lines.select(*sort, "line")
        total = keyed.agg(F.count("*"), F.sum(F.xxhash64(*sort, "line").cast("decimal(38,0)"))).first()
        stamp = f"{total[0]}:{total[1]}"
        target = f"{self.root}/{relative}"
        known = self._read_text(f"{target}.hash")
        if known is not None:
            if known != stamp:
                raise Conflict("immutable_snapshot_conflict")
            return
        # A crash between the two writes leaves no hash, so the folder is written again.
        keyed.orderBy(*sort).select("line").write.mode("overwrite").text(target)
        self._write_text(f"{target}.hash", stamp)

    def report(self, relative: str, run: dict) -> None:
        self._swap(f"{self.root}/{relative}", json.dumps(run, ensure_ascii=False, sort_keys=True, indent=2, default=str) + "\n")


def newest(base: DataFrame, changes: DataFrame, order: dict[str, int], keys: list[str], small: bool) -> DataFrame:
    """Rows of the last version that has their key; `order` numbers the folders that the changes lie in.

    All changes are one scan. They are reduced first, and the base only loses the rows they replace, so it is not
    shuffled where the stored changes are small.
    """
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    place = F.element_at(F.create_map(*(F.lit(x) for pair in order.items() for x in pair)), folder)
    latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), place).alias("_row")).select("_row.*")
    marked = changes.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = test if same is None else same & test
    return base.join(F.broadcast(marked) if small else marked, same, "left_anti").unionByName(latest)


# Export columns in their order.
EXPORT_COLUMNS = ("base_id", "version_id", "published_local", "title", "link", "categories", "routes", "matched_groups", "abstract")


def export_rows(matches: DataFrame) -> DataFrame:
    """Flat export rows: lists and maps as JSON text."""
    kinds = dict(matches.dtypes)
    flat = [F.to_json(c).alias(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c) for c in EXPORT_COLUMNS]
    return matches.select(*flat)


def export_csv(matches: DataFrame, path: str) -> None:
    export_rows(matches).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def html_rows(matches: DataFrame, limit: int = 100) -> DataFrame:
    """First rows of a match list as HTML table rows (a display limit)."""
    cell = lambda value: F.concat(F.lit("<td style='padding:8px;border-top:1px solid #ddd'>"), value, F.lit("</td>"))
    joined = lambda name: html_escape(F.array_join(name, ", "))
    link = F.concat(F.lit('<a href="'), html_escape(F.col("link")), F.lit('" target="_blank">'), html_escape(F.col("title")), F.lit("</a>"))
    row = F.concat(F.lit("<tr>"), cell(html_escape(F.col("published_local"))), cell(link), cell(joined("categories")), cell(joined("routes")), F.lit("</tr>"))
    ordered = matches.orderBy(F.desc("published"), F.desc("base_id")).limit(limit)
    return ordered.select("published", "base_id", row.alias("row"))
