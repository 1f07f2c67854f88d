"""Tables on shared storage: audits by batch and day, rollups by day, rule changes, quarantine.

Parquet has no MERGE, so an upsert is a new part: a folder for each table of one batch, listed in a commit entry (``commits``) and read
through a view that keeps the last verdict per audit id. Folders are per day. Within a day the files are time slices where the
events came in time order or were dealt by it (``spread``), so a range of hours is pruned by the row groups' statistics.

With each part goes a small table of facts: for each hour, topic and partition the lowest and highest offset, the counts and a
mergeable sketch of the distinct records. An audit keeps its record's place and time in every version, so only parts whose offset ranges overlap can hold the same audit.

Ids that follow from an audit's place and rule aren't stored but made when they are read, and don't travel (``keys.without_ids``).
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbitrail import schema as S
from arbitrail.functions import keys
from arbitrail.functions.text import hour_key
from arbitrail.operators import analytics as N
from arbitrail.operators import report
from arbitrail.operators import rollup as R
from arbitrail.operators.clauses import rule
from arbitrail.operators.rules import rule_frame
from arbitrail.session import folder_exists, one_writer, remove_folder
from arbitrail.sources.commits import CommitLog

_BATCH = ["stream", "run_seq", "batch_id"]
_KINDS = {"matched": S.MATCHED, "unmatched": S.UNMATCHED, "errored": S.ERRORED}
_PLACE = ["hour", "topic", "partition"]
_FACTS = "hour string, topic string, partition int, low bigint, high bigint, audits bigint, messages bigint, matched bigint, unmatched bigint, errored bigint, sketch binary, part string"
COMPACTED = "compacted"
#: The column by which days are clustered.
_CLUSTERED = "half_id"
#: Stretches of shared offsets are broadcast while they have at most so many bytes, of about so many each beside the topic.
BROADCAST_BYTES, _STRETCH_BYTES = 32 << 20, 100


def _columns(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out


def _half_id(audit_id: Column) -> Column:
    """Half of an id's bytes, which name it as well; of an id that isn't a hash all of it."""
    return F.coalesce(F.unhex(F.substring(audit_id, 1, 32)), audit_id.cast("binary"))


def _is_clustered(part: dict) -> bool:
    """Whether a part's files are bucketed by ``_CLUSTERED``; those of older ones, bucketed by the id's text, are read like any others."""
    return part["buckets"] > 0 and part.get("clustered") == _CLUSTERED


def first_of_each(packed: DataFrame, *order) -> DataFrame:
    """The first row of each audit, of rows without made ids: one exchange by eight bytes for each record, without ids."""
    keyed = packed.withColumn("id_bytes", keys.record_hash()).repartition("id_bytes")
    best = Window.partitionBy("id_bytes", *keys.identity()).orderBy(*order)
    return keyed.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank", "id_bytes")


def _table_name(part: dict) -> str:
    """The session's name for the files of a part that is clustered by id."""
    return f"audits_part_{part['name']}"


class BatchWriter:
    """One batch of a store on its way: its tables are written as they come and seen all at once, or never."""

    def __init__(self, store: AuditStore, run_seq: int, batch_id: int, stream: str):
        self.store, self.name = store, uuid.uuid4().hex
        self.key = [stream, run_seq, batch_id]
        self.part = {"name": self.name, **dict(zip(_BATCH, self.key, strict=True)), "days": [], "hours": [], "origins": [self.key], "hidden": [], "buckets": 0, "folders": {}}

    def audits(self, audits: DataFrame, buckets: int = 0) -> DataFrame:
        """Writes the batch's audits, each id once, and their facts; returns them as written.

        With ``buckets`` each day's audits lie in so many buckets by id, sorted by it, so that versions meet without being moved.
        """
        self.part["buckets"] = buckets
        named = dict(zip(_BATCH, (F.lit(x) for x in self.key), strict=True))
        named["batch_id"] = named["batch_id"].cast("bigint")
        rows = audits.withColumns({k: v for k, v in named.items() if k not in audits.columns})
        folder = self._write(rows)
        events = self.store._events_of(self.store._read([folder]))
        if not events.where("repeats").isEmpty():  # one exchange, in which an event's audits stay together
            written = self.store._packed([folder])
            order = F.desc_nulls_last("processed_at"), F.desc("rule_version"), "code", "failed_clause_no", "reason"
            once = first_of_each(written, *order).drop("day", "part")
            folder = self._write(once)
            events = self.store._events_of(self.store._read([folder]))
        facts = f"{self.store.root}/facts/part={self.name}"
        sums = [F.sum(c).alias(c) for c in ("audits", *_KINDS)]
        sketch = R.message_sketch("topic").alias("sketch")
        per_place = events.groupBy(*_PLACE).agg(F.min("offset").alias("low"), F.max("offset").alias("high"), F.count("*").alias("messages"), *sums, sketch)
        per_place.withColumn("hour", hour_key(F.col("hour"))).coalesce(1).write.parquet(facts)
        hours = [r[0] for r in self.store.spark.read.parquet(facts).select("hour").distinct().orderBy("hour").collect()]
        self.part |= {"days": sorted({h[:10] for h in hours}), "hours": hours}
        self.part["folders"] |= {"audits": folder, "facts": facts}
        return self.store._rows([self.part])

    def _write(self, rows: DataFrame) -> str:
        """Writes the batch's audits in a new folder; a first writing that this one replaces is deleted once it is read.

        A task's rows go by day, time and event, so that an event's audits lie side by side and their ids and places compress.
        """
        spark, folder, stale = self.store.spark, f"{self.store.root}/audits/part={self.name}", None
        if folder_exists(spark, folder):  # written a second time, without repeats; the first was never published
            stale = (folder, _table_name(self.part))
            self.name = self.part["name"] = uuid.uuid4().hex
            folder = f"{self.store.root}/audits/part={self.name}"
        rows = keys.without_ids(rows).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
        buckets = self.part["buckets"]
        if buckets:  # each task writes its ids' share of every bucket, so that a batch isn't held by as few tasks as it has buckets
            order = [*S.AUDITS.fieldNames(), keys.IDS_MADE, *_BATCH, _half_id(keys.full_audit_id()).alias(_CLUSTERED), "day"]
            self.part["clustered"] = _CLUSTERED
            clustered = rows.select(*order).repartition(_CLUSTERED).write.partitionBy("day").bucketBy(buckets, _CLUSTERED).sortBy(_CLUSTERED)
            clustered.option("path", folder).option("compression", "zstd").format("parquet").saveAsTable(_table_name(self.part))
        else:
            ordered = rows.sortWithinPartitions("day", "timestamp", "source_topic", "partition", "offset", "event_id")
            with one_writer(ordered.sparkSession):
                ordered.write.option("compression", "zstd").partitionBy("day").parquet(folder)
        if stale:
            spark.sql(f"DROP TABLE IF EXISTS {stale[1]}")
            remove_folder(spark, stale[0])
        return folder

    def table(self, name: str, rows: DataFrame) -> None:
        """Writes the batch's rows of another table."""
        folder = f"{self.store.root}/{name}/part={self.name}-{uuid.uuid4().hex[:8]}"
        rows.write.option("compression", "zstd").parquet(folder)
        self.part["folders"][name] = folder

    def publish(self) -> None:
        """Makes all that was written visible, in place of an earlier writing of the same batch."""

        new = set(self.part["folders"])
        lost = new | ({"rules"} if "audits" in new else set())

        def change(entry: dict) -> dict:
            parts, stale = [], set(entry["stale"])
            for p in entry["parts"]:
                own = [p[c] for c in _BATCH] == self.key
                again = "audits" in new & set(p["folders"]) and self.key in p["origins"] and self.key not in p["hidden"]
                if again:
                    stale |= set(p["hours"])
                if again and p["origins"] != [self.key]:  # compacted with others: only its rows are passed over
                    p = {**p, "hidden": [*p["hidden"], self.key]}
                elif again or own:
                    p = {**p, "folders": {t: f for t, f in p["folders"].items() if t not in lost}, **({"days": [], "hours": []} if again else {})}
                if p["folders"]:
                    parts.append(p)
            return {**entry, "parts": [*parts, self.part], "stale": sorted(stale)}

        self.store.log.publish(change)


class AuditStore:
    """Audits, routed events, quarantine and rollups below one folder.

    A batch is named by the stream that wrote it, its run and its number; only a replay of that very batch replaces it. What counts is
    what the newest commit entry lists; a part that no entry lists is never read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, self.root)

    # --- audits ---------------------------------------------------------------------------------

    def begin(self, run_seq: int, batch_id: int, stream: str = "batch") -> BatchWriter:
        """A batch of several tables, seen when it is published."""
        return BatchWriter(self, run_seq, batch_id, stream)

    def write_batch(self, audits: DataFrame, run_seq: int, batch_id: int, stream: str = "batch", buckets: int = 0) -> str:
        """Writes one batch of audits; writing it again replaces it. Of equal ids within it one stays. Returns its folder.

        A rerun of many compacted days is best written with as many ``buckets`` as these have.
        """
        batch = self.begin(run_seq, batch_id, stream)
        batch.audits(audits, buckets)
        batch.publish()
        return batch.part["folders"]["audits"]

    def _events_of(self, rows: DataFrame) -> DataFrame:
        """(hour, topic, partition, offset, audits by kind, repeats) of each event of one part. The audits of an event lie side by side, so they are added up before
        they travel. repeats: the event may hold an id twice, as it has neither one audit nor one of each rule of the part."""
        mark = F.xxhash64("rule_id")
        rules = rows.where(~F.col("rule_id").isin(S.RULE_PARSE, S.RULE_NONE)).select("rule_id").distinct().agg(F.count("*").alias("n"), F.bit_xor(mark).alias("marks")).first()
        place = [F.date_trunc("hour", "timestamp").alias("hour"), F.col("source_topic").alias("topic"), "partition", "offset"]
        kinds = [F.count_if(F.col("audit_type") == kind).alias(name) for name, kind in _KINDS.items()]
        events = rows.groupBy(*place).agg(F.count("*").alias("audits"), *kinds, F.bit_xor(mark).alias("marks"))
        whole = (F.col("audits") == rules["n"]) & (F.col("marks") == F.lit(rules["marks"]).cast("bigint"))
        return events.withColumn("repeats", (F.col("audits") > 1) & ~F.coalesce(whole, F.lit(False)))

    def _read(self, folders: list[str]) -> DataFrame:
        return keys.with_ids(self._packed(folders))

    def _packed(self, folders: list[str]) -> DataFrame:
        """Rows as they are stored, without the ids that can be made."""
        schema = f"{_columns(S.AUDITS)}, {keys.IDS_MADE} tinyint, stream string, run_seq int, batch_id bigint, part string, day string"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/audits").parquet(*folders)

    def _parts(self, entry: dict | None = None) -> list[dict]:
        """The live parts that hold audits."""
        return [p for p in (entry or self.log.read())["parts"] if "audits" in p["folders"]]

    def _rows(self, parts: list[dict], days: set[str] | None = None) -> DataFrame:
        """The rows of some parts; of the days alone that count in a part, and of these only the wanted."""
        return keys.with_ids(self._packed_rows(parts, days))

    def _packed_rows(self, parts: list[dict], days: set[str] | None = None) -> DataFrame:
        rows = self._packed([f"{p['folders']['audits']}/day={d}" for p in parts for d in p["days"] if days is None or d in days])
        for p in parts:
            rows = self._without_hidden(rows, p)
        return rows

    def _without_hidden(self, rows: DataFrame, part: dict) -> DataFrame:
        for key in part["hidden"]:  # written again after it was compacted
            own = F.col("part") == part["name"]
            for name, value in zip(_BATCH, key, strict=True):
                own &= F.col(name) == F.lit(value)
            rows = rows.where(~own)
        return rows

    def _clustered(self, part: dict, days: list[str]) -> DataFrame:
        """Some days of a part that is clustered by id, as a table whose buckets Spark knows; a new session is told of them first."""
        name = _table_name(part)
        if not self.spark.catalog.tableExists(name):
            columns = f"{_columns(S.AUDITS)}, {keys.IDS_MADE} tinyint, stream string, run_seq int, batch_id bigint, {_CLUSTERED} binary, day string"
            by = f"CLUSTERED BY ({_CLUSTERED}) SORTED BY ({_CLUSTERED}) INTO {part['buckets']} BUCKETS"
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (day) {by} LOCATION '{part['folders']['audits']}'")
            self.spark.catalog.recoverPartitions(name)
        rows = self.spark.table(name).where(F.col("day").isin(days)).withColumn("part", F.lit(part["name"]))
        return self._without_hidden(rows, part)

    def _merged(self, clustered: dict, days: list[str], others: list[dict]) -> DataFrame:
        """Last verdicts of some days of a clustered part and of other parts. Its rows stay in their buckets; the others' come to them, or stay in
        theirs if they are one part with as many."""
        if len(others) == 1 and _is_clustered(others[0]) and others[0]["buckets"] == clustered["buckets"]:
            more = self._clustered(others[0], others[0]["days"])
        else:
            more = latest_audits(self._packed_rows(others)).withColumn(_CLUSTERED, _half_id(keys.full_audit_id()))
        names = [c for c in more.columns if c != _CLUSTERED]
        sides = [rows.select(_CLUSTERED, F.struct(*names).alias(side)) for side, rows in (("a", self._clustered(clustered, days)), ("b", more))]
        version = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in ("run_seq", "processed_at", "batch_id", "stream", "part")])
        first = F.col("b").isNull() | (F.col("a").isNotNull() & (version("a") > version("b")))
        return sides[0].join(sides[1], _CLUSTERED, "full_outer").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("won")).select("won.*")

    def all_versions(self) -> DataFrame:
        return self._rows(self._parts())

    def batch(self, run_seq: int, batch_id: int, stream: str = "batch") -> DataFrame:
        """One batch, listing only its own folder."""
        return self._rows([p for p in self._parts() if [p[c] for c in _BATCH] == [stream, run_seq, batch_id]]).drop("stream", "part")

    def _facts(self, parts: list[dict]) -> DataFrame:
        """The facts of some parts, with their day, for the days that count in a part."""
        if not parts:
            return self.spark.createDataFrame([], _FACTS + ", day string")
        facts = self.spark.read.schema(_FACTS).option("basePath", f"{self.root}/facts").parquet(*[p["folders"]["facts"] for p in parts])
        facts = facts.withColumn("day", F.substring("hour", 1, 10))
        live = self.spark.createDataFrame([(p["name"], d) for p in parts for d in p["days"]], "part string, day string")
        return facts.join(live, ["part", "day"], "left_semi")

    def touched(self) -> DataFrame:
        """(hour, audits, stream, run_seq, batch_id) of each part."""
        parts = self._parts()
        names = self.spark.createDataFrame([(p["name"], *[p[c] for c in _BATCH]) for p in parts], "part string, stream string, run_seq int, batch_id bigint")
        return self._facts(parts).groupBy("part", "hour").agg(F.sum("audits").alias("audits")).join(names, "part").select("hour", "audits", *_BATCH)

    def _overlaps(self, facts: DataFrame) -> DataFrame:
        """(hour, topic, partition, low, high, parts): where parts share a stretch of offsets, and which parts.

        Ranges of a place are walked in order of their lowest offset; one that begins before the highest one so far has ended overlaps.
        """
        order = Window.partitionBy(*_PLACE).orderBy("low", "high", "part")
        before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
        marked = facts.withColumn("before", before).withColumn("apart", F.coalesce(F.col("low") > F.col("before"), F.lit(True)).cast("int"))
        marked = marked.withColumn("group", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        met = F.when(F.col("apart") == 0, F.col("low")), F.when(F.col("apart") == 0, F.least("high", "before"))
        groups = marked.groupBy(*_PLACE, "group").agg(F.min(met[0]).alias("low"), F.max(met[1]).alias("high"), F.collect_set("part").alias("parts"))
        return groups.where(F.size("parts") > 1).drop("group")

    def latest(self, start: Column | None = None, end: Column | None = None, days: list[str] | None = None) -> DataFrame:
        """Last verdict per audit. An audit keeps its time in every run, so a range may be cut first.

        Parts whose offset ranges meet no other part's are only scanned. Days clustered by id are merged with the others bucket by bucket. Of
        all else, rows outside the shared stretches pass by, and the rest is compared in one exchange by id.
        """
        parts = self._parts()
        wanted = {d for p in parts for d in p["days"]} & (set(days) if days is not None else {d for p in parts for d in p["days"]})
        ranges = [(bound, name, self._day(bound)) for bound, name in ((start, "__ge__"), (end, "__le__")) if bound is not None]
        for _, name, day in ranges:
            wanted = {d for d in wanted if getattr(d, name)(day)}

        def cut(rows: DataFrame) -> DataFrame:
            for bound, name, _ in ranges:
                rows = rows.where(getattr(F.col("timestamp"), name)(bound))
            return rows

        shared, overlaps = self._shared(parts, wanted)
        drop = ["day", "stream", "part"]
        alone = [{**p, "days": [d for d in p["days"] if (p["name"], d) not in shared]} for p in parts]
        out = cut(self._packed_rows(alone, wanted))
        for c in (p for p in parts if _is_clustered(p)):
            of_days = [d for d in c["days"] if (c["name"], d) in shared]
            if of_days:
                others = [{**p, "days": [d for d in p["days"] if d in of_days and (p["name"], d) in shared]} for p in parts if p is not c]
                out = out.unionByName(cut(self._merged(c, of_days, [p for p in others if p["days"]])))
                shared = {(name, d) for name, d in shared if d not in of_days}
        if shared:
            both = [{**p, "days": [d for d in p["days"] if (p["name"], d) in shared]} for p in parts]
            rows = cut(self._packed_rows(both, wanted)).withColumns({"hour": hour_key(F.col("timestamp")), "topic": F.col("source_topic")})
            inside = _same(rows, overlaps, _PLACE) & F.coalesce(rows["offset"].between(overlaps["low"], overlaps["high"]), F.lit(True))
            out = out.unionByName(rows.join(overlaps, inside, "left_anti").drop("hour", "topic"))
            out = out.unionByName(latest_audits(rows.join(overlaps, inside, "left_semi")).drop("hour", "topic"))
        return keys.with_ids(out).drop(*drop)

    def _shared(self, parts: list[dict], days: set[str]) -> tuple[set[tuple[str, str]], DataFrame | None]:
        """(part, day) pairs that can hold audits of another part, and the stretches of offsets these share."""
        written: dict[str, int] = {}
        for d in (d for p in parts for d in p["days"] if d in days):
            written[d] = written.get(d, 0) + 1
        several = {d for d, n in written.items() if n > 1}
        if not several:
            return set(), None
        met = [{**p, "days": [d for d in p["days"] if d in several]} for p in parts]
        overlaps = self._overlaps(self._facts([p for p in met if p["days"]]))
        pairs = overlaps.select(F.explode("parts").alias("part"), F.substring("hour", 1, 10).alias("day")).distinct().collect()  # of folders, not of rows
        stretches = overlaps.drop("parts")
        size = stretches.agg(F.sum(F.coalesce(F.length("topic"), F.lit(0)) + _STRETCH_BYTES)).first()[0] or 0
        # told of a few places and hours, the rows stay where they are while they are compared with them
        return {(r["part"], r["day"]) for r in pairs}, F.broadcast(stretches) if size <= BROADCAST_BYTES else stretches

    def _day(self, moment: Column) -> str:
        return self.spark.range(1).select(F.date_format(moment, "yyyy-MM-dd")).first()[0]

    def compact(self, run_seq: int, start: Column, end: Column, buckets: int = 0) -> None:
        """Keeps only the last verdicts of the whole days within a range, in one new part, clustered by id with ``buckets``.

        Each audit keeps the run, batch, stream and time that judged it, so that a later run still wins and an earlier one still loses. The
        old folders go from the list with the same entry that adds the new one, and from the disk some commits later.
        """
        first, last = self._day(start), self._day(end)
        whole_first = self.spark.range(1).select(start == F.date_trunc("day", start)).first()[0]
        entry = self.log.read()
        old = [p for p in self._parts(entry) if any(first <= d < last and (d > first or whole_first) for d in p["days"])]
        days = sorted({d for p in old for d in p["days"] if first <= d < last and (d > first or whole_first)})
        if not days:
            return
        names = {p["name"] for p in old}
        batch = self.begin(run_seq, uuid.uuid4().int >> 66, COMPACTED)
        batch.audits(self._latest_of(entry, set(days)), buckets)
        batch.part["origins"] = [list(x) for x in sorted({tuple(o) for p in old for o in p["origins"] if o not in p["hidden"]})]

        def change(now: dict) -> dict:
            live = {p["name"]: p for p in now["parts"]}
            if any(n not in live or live[n]["hidden"] != next(p for p in old if p["name"] == n)["hidden"] for n in names):
                raise RuntimeError("a batch was replaced while it was compacted; compact again")
            parts = []
            for p in now["parts"]:
                if p["name"] in names:
                    p = {**p, "days": [d for d in p["days"] if d not in days], "hours": [h for h in p["hours"] if h[:10] not in days]}
                    if not p["days"]:
                        p["folders"] = {t: f for t, f in p["folders"].items() if t not in ("audits", "facts", "rules")}
                if p["folders"]:
                    parts.append(p)
            rolled = [*now["rolled"], batch.name] if names <= set(now["rolled"]) else now["rolled"]
            return {**now, "parts": [*parts, batch.part], "rolled": rolled}

        self.log.publish(change)

    def _latest_of(self, entry: dict, days: set[str]) -> DataFrame:
        """Last verdicts of some days with the columns of their versions."""
        parts = self._parts(entry)
        shared, _ = self._shared(parts, days)
        rows = self._packed_rows(parts, days).drop("day")
        return (latest_audits(rows) if shared else rows).drop("part")

    # --- rules as they judged --------------------------------------------------------------------

    def write_rule_texts(self, texts: DataFrame, version: int) -> None:
        """Texts of one version of the rules, for ``full_audits``; kept once however often it comes."""
        texts.select("rule_id", "expression", "paths").write.mode("overwrite").parquet(f"{self.root}/rule_texts/rule_version={version}")

    def rule_texts(self) -> DataFrame:
        return self._table("rule_texts", "rule_id string, expression string, paths array<string>, rule_version bigint")

    def knows_version(self, version: int) -> bool:
        """Whether texts and load errors of a version of the rules are stored; the texts come last."""
        return folder_exists(self.spark, f"{self.root}/rule_texts/rule_version={version}/_SUCCESS")

    def write_load_errors(self, errors: DataFrame, version: int) -> None:
        """(rule_id, verdict) of the rules of one version that can't be evaluated as they are; kept once however often it comes."""
        errors.select("rule_id", "verdict").write.mode("overwrite").parquet(f"{self.root}/load_errors/rule_version={version}")

    def load_errors(self) -> DataFrame:
        return self._table("load_errors", "rule_id string, verdict string, rule_version bigint")

    # --- routed events and quarantine -------------------------------------------------------------

    def write_part(self, name: str, rows: DataFrame, run_seq: int, batch_id: int, stream: str = "batch") -> None:
        batch = self.begin(run_seq, batch_id, stream)
        batch.table(name, rows)
        batch.publish()

    def part(self, name: str) -> DataFrame:
        """The rows of another table in all live parts."""
        folders = [p["folders"][name] for p in self.log.read()["parts"] if name in p["folders"]]
        return self.spark.read.parquet(*folders)

    # --- rollups ----------------------------------------------------------------------------------

    def refresh_rollups(self, as_of: Column, hours: int = S.RECOMPUTE_HOURS, enabled: bool = True) -> None:
        """The periodic job, and with more hours the backfill.

        Renewed are the hours of the trailing window and every hour, however old, that a part has touched or left since the last
        refresh, so that a replay takes back the counts of what it replaces. Each part is counted once, when it is new; an hour
        whose parts share no audits is the sum of their counts, and only hours in which they do are computed from last verdicts.
        """
        if not enabled:
            return
        entry = self.log.read()
        parts = self._parts(entry)
        new = [p for p in parts if p["name"] not in entry["rolled"]]
        window = self.spark.range(1).select(hour_key(R.window_start(as_of, hours))).first()[0]
        wanted = {h for p in new for h in p["hours"]} | set(entry["stale"]) | {h for p in parts for h in p["hours"] if h >= window}
        if not wanted:
            return
        days = {h[:10] for h in wanted}
        counted = self._count_parts([p for p in parts if "rules" not in p["folders"] and days & set(p["days"])])
        of_days = [{**p, "days": [d for d in p["days"] if d in days], "folders": {**p["folders"], **counted.get(p["name"], {})}} for p in parts]
        of_days = [p for p in of_days if p["days"]]
        facts = self._facts(of_days)
        hour_list = self.spark.createDataFrame([(h,) for h in sorted(wanted)], "hour string")
        met = {r[0] for r in self._overlaps(facts).select("hour").distinct().collect()} | {h for p in of_days if p["hidden"] for h in p["hours"]}
        compared = sorted(wanted & met)
        simple = hour_list.where(~F.col("hour").isin(compared)) if compared else hour_list
        of_rules, of_hours = self._sums(of_days, facts, simple)
        winners = None
        try:
            if compared:
                narrow = self.latest(days=sorted({h[:10] for h in compared})).select(
                    "timestamp", "rule_id", "audit_type", "source_topic", "partition", "offset", "parse_time_nano", "eval_time_nano", "total_time_nano"
                )
                winners = narrow.where(hour_key(F.col("timestamp")).isin(compared)).persist()  # narrow rows, used for both rollups
                of_rules, of_hours = of_rules.unionByName(R.rule_rollups(winners)), of_hours.unionByName(R.hour_rollups(winners))
            fresh = {}
            for name, rows in (("rule_rollups", of_rules), ("hour_rollups", of_hours)):
                kept = self._rollups(name, days, entry).join(F.broadcast(hour_list), "hour", "left_anti")
                merged = kept.unionByName(rows.withColumn("day", F.substring("hour", 1, 10)))
                folder = f"{self.root}/{name}/refresh={uuid.uuid4().hex}"
                merged.repartitionByRange("day", "hour").write.partitionBy("day").parquet(folder)
                fresh[name] = {d: f"{folder}/day={d}" for d in days if folder_exists(self.spark, f"{folder}/day={d}")}
        finally:
            if winners is not None:
                winners.unpersist()
        seen = {p["name"] for p in parts}

        def change(now: dict) -> dict:
            live = [{**p, "folders": {**p["folders"], **counted.get(p["name"], {})}} if "audits" in p["folders"] else p for p in now["parts"]]
            rollups = {name: {**{d: f for d, f in now["rollups"].get(name, {}).items() if d not in days}, **fresh[name]} for name in fresh}
            return {**now, "parts": live, "rollups": rollups, "rolled": sorted(seen & {p["name"] for p in live}), "stale": sorted(set(now["stale"]) - (wanted if now["commit"] == entry["commit"] else set()))}

        self.log.publish(change)

    def _count_parts(self, parts: list[dict]) -> dict[str, dict[str, str]]:
        """Rollups by rule of each of some parts, stored by part: their folder by part name."""
        if not parts:
            return {}
        folder = f"{self.root}/part_rules/{uuid.uuid4().hex}"
        rows = self._rows(parts)
        by_part = R.rule_rollups(rows, "part")
        by_part.repartition("part").write.partitionBy("part").parquet(folder)
        return {p["name"]: {"rules": f"{folder}/part={p['name']}"} for p in parts}

    def _sums(self, parts: list[dict], facts: DataFrame, hours: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both rollups of hours whose parts share no audits, added up from the parts' own counts."""
        sums = [F.sum(c).alias(c) for c in S.RULE_ROLLUPS.fieldNames() if c not in ("hour", "rule_id")]
        live = self.spark.createDataFrame([(p["name"], d) for p in parts for d in p["days"]], "part string, day string")
        counts = self.spark.createDataFrame([], f"{_columns(S.RULE_ROLLUPS)}, part string")
        for base in sorted({p["folders"]["rules"].rsplit("/", 1)[0] for p in parts}):  # parts counted together lie in one folder
            counts = counts.unionByName(self.spark.read.schema(f"{_columns(S.RULE_ROLLUPS)}, part string").parquet(base))
        counts = counts.withColumn("day", F.substring("hour", 1, 10)).join(live, ["part", "day"], "left_semi").join(F.broadcast(hours), "hour", "left_semi")
        of_hours = facts.join(F.broadcast(hours), "hour", "left_semi").groupBy("hour").agg(F.sum("messages").alias("messages"))
        return counts.groupBy("hour", "rule_id").agg(*sums).select(*S.RULE_ROLLUPS.fieldNames()), of_hours

    def rule_rollups(self, start: Column | None = None, end: Column | None = None) -> DataFrame:
        return self._between("rule_rollups", start, end)

    def hour_rollups(self, start: Column | None = None, end: Column | None = None) -> DataFrame:
        return self._between("hour_rollups", start, end)

    def messages(self, start: Column, end: Column) -> DataFrame:
        """(messages): about how many distinct records the hours of a range have, from sketches alone (``rollup.distinct_messages``).

        Reruns and compactions of a record change nothing. A record that only a replaced version had goes with it, but in parts of a
        compaction only with the next one.
        """
        low, high = self.spark.range(1).select(hour_key(start), hour_key(end)).first()
        parts = [p for p in self._parts() if any(low <= h <= high for h in p["hours"])]
        return R.distinct_messages(N.in_range(self._facts(parts), start, end))

    def _between(self, name: str, start: Column | None, end: Column | None) -> DataFrame:
        """Rollups of the hours of a range; only the folders of its days are read."""
        entry = self.log.read()
        days = set(entry["rollups"].get(name, {}))
        for bound, compare in ((start, "__ge__"), (end, "__le__")):
            if bound is not None:
                day = self._day(bound)
                days = {d for d in days if getattr(d, compare)(day)}
        rows = self._rollups(name, days, entry)
        for bound, compare in ((start, "__ge__"), (end, "__le__")):
            if bound is not None:
                rows = rows.where(getattr(F.col("hour"), compare)(hour_key(bound)))
        return rows.drop("day")

    # --- answers from the store -------------------------------------------------------------------

    def dashboard(self, as_of: Column, start: Column | None = None, end: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Totals, rule statistics and time series of a range, by default the day before ``as_of``."""
        start, end = report.last_day(as_of, start, end)
        return N.dashboard(self.rule_rollups(start, end), self.hour_rollups(start, end))

    def top(self, audit_type: str, as_of: Column, start: Column | None = None, end: Column | None = None, n: int = 10) -> DataFrame:
        """The newest audits of one type.

        Hours are taken newest first, as many as hold enough by the counts of their parts, and more only while too few of these are last verdicts of
        the range; no earlier hour is read.
        """
        start, end = report.last_day(as_of, start, end)
        low, high = self.spark.range(1).select(hour_key(start), hour_key(end)).first()
        parts = [p for p in self._parts() if any(low <= h <= high for h in p["hours"])]
        found = self._facts(parts).where(F.col("hour").between(low, high)).groupBy("hour").agg(F.sum({v: k for k, v in _KINDS.items()}[audit_type]).alias("n"))
        hours = [tuple(r) for r in found.where("n > 0").orderBy(F.desc("hour")).collect()]  # a row for each hour of the range
        take, enough = 0, n
        while True:
            while take < len(hours) and sum(k for _, k in hours[:take]) < enough:
                take += 1
            since = start if take == len(hours) else F.greatest(start, F.to_timestamp(F.lit(hours[take - 1][0])))
            rows = report.top(self.latest(since, end), audit_type, since, end, n)
            if take == len(hours) or rows.count() >= n:
                return rows
            enough = 2 * sum(k for _, k in hours[:take]) + 1

    def export_csv(self, audit_type: str, as_of: Column, start: Column | None = None, end: Column | None = None) -> DataFrame:
        start, end = report.last_day(as_of, start, end)
        return report.export_csv(self.latest(start, end), audit_type, start, end)

    def _rollups(self, name: str, days: set[str], entry: dict) -> DataFrame:
        schema = f"{_columns(S.RULE_ROLLUPS if name == 'rule_rollups' else S.HOUR_ROLLUPS)}"
        folders = [f for d, f in sorted(entry["rollups"].get(name, {}).items()) if d in days]
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return rows.withColumn("day", F.substring("hour", 1, 10))

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table of the store, without rows while its folder isn't there; any other fault is one."""
        if not folder_exists(self.spark, f"{self.root}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")


def latest_audits(versions: DataFrame) -> DataFrame:
    """The version with the highest (run_seq, processed_at, batch_id, stream) per audit id: one exchange, by half of the id's bytes, or of rows
    without made ids by eight bytes of the record's."""
    order = [F.desc_nulls_last(c) for c in ("run_seq", "processed_at", "batch_id", "stream", "part") if c in versions.columns]
    if keys.IDS_MADE in versions.columns:
        return first_of_each(versions, *order)
    keyed = versions.withColumn("id_bytes", _half_id(F.col("audit_id")))
    best = Window.partitionBy("id_bytes").orderBy(*order)
    return keyed.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank", "id_bytes")


class RuleLog:
    """Append-only rule changes; the current table is their latest state per rule."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/rule_changes"

    def append(self, changes: DataFrame) -> None:
        changes.write.mode("append").parquet(self.path)

    def put(self, row: dict, seq: int, moment: datetime, rule_id: str | None = None) -> None:
        """Creates or updates one rule; a given ``rule_id`` wins over the row's own."""
        named = {**row, "rule_id": rule_id or row["rule_id"], "updated_at": moment}
        self.append(rule_frame(self.spark, [named]).withColumns({"seq": F.lit(seq).cast("bigint"), "op": F.lit("put")}))

    def delete(self, rule_id: str, seq: int, moment: datetime) -> None:
        """Removes a rule; deleting one that is not there changes nothing."""
        gone = {**rule(rule_id, None, []), "updated_at": moment}
        self.append(rule_frame(self.spark, [gone]).withColumns({"seq": F.lit(seq).cast("bigint"), "op": F.lit("delete")}))

    def changes(self) -> DataFrame:
        return self.spark.read.parquet(self.path)
