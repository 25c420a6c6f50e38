"""The registration table: who is to be told about a txid, kept on disk, updated by batches, read while it changes.

Below its folder lie

* `base/v=<n>_upto=<batch>_buckets=<k>`: a row a txid with its urls, tokens and expiry, in buckets by txid and sorted; the
  highest version that is complete counts. Every version holds all changes up to its batch.
* `sketch/v=<n>_words=<w>`: a Bloom sketch of the version's txids, if it is not too large; batches add theirs;
* `log/batch=<n>/add` (txid, url, token, seq) and `log/batch=<n>/ttl` (txid, expires_at): the changes of one batch, replaced
  if the batch is replayed.

Reads merge: a lookup joins the base, which is not shuffled, and the log, which compaction keeps short. Compaction folds the
log into the next base version, bucket by bucket, and drops what has expired: it is the sweeper. So between two compactions nothing is ever removed, and an expired
row answers lookups until it is swept.

Rules: a pair that is registered again gets the new token (the last in order counts) and keeps its expiry; an expiry is set
on txids that are in the table when its batch runs, additions of the same batch included, and a null one means never; a txid
takes at most `cap` urls, a request beyond is answered and not stored; a txid that was swept starts anew. Requests with a
null txid or url are refused. One writer at a time, batches in ascending numbers; readers may run beside it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txloom.operators import bloom

ADD = "txid string, url string, token string, seq long"
TTL = "txid string, expires_at timestamp_ntz"
ROW = "txid string, callbacks array<struct<url: string, token: string>>, expires_at timestamp_ntz"
BUCKETS = 16


def _both() -> Column:
    """callbacks with those of news, which go before the old ones of the same url, in the order of urls."""
    old, new = (F.coalesce(F.col(c), F.array().cast("array<struct<url: string, token: string>>")) for c in ("callbacks", "news"))
    urls = F.transform(new, lambda n: n["url"])
    return F.array_sort(F.concat(F.filter(old, lambda c: ~F.array_contains(urls, c["url"])), new))


class RegistrationTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """The table at path; buckets only counts when its first version is made (a table keeps its number)."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._named: tuple[int, str] | None = None

    # --- what lies on disk

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _complete(self, path: str) -> bool:
        fs, p = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def versions(self) -> list[tuple[int, int, int, str]]:
        """(version, last batch, buckets, folder) of the complete base versions, in order."""
        out = []
        for name in self._names(f"{self.path}/base"):
            v, upto, buckets = (int(x.partition("=")[2]) for x in name.split("_"))
            if self._complete(f"{self.path}/base/{name}"):
                out.append((v, upto, buckets, f"{self.path}/base/{name}"))
        return sorted(out)

    def _log(self, kind: str, after: int, before: int | None) -> DataFrame:
        """The changes of a kind in the batches after `after` and (if given) before `before`, with their batch."""
        schema = ADD if kind == "add" else TTL
        batches = [int(n.partition("=")[2]) for n in self._names(f"{self.path}/log")]
        wanted = [b for b in sorted(batches) if b > after and (before is None or b < before) and self._complete(f"{self.path}/log/batch={b}/{kind}")]
        if not wanted:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        read = self.spark.read.schema(schema).parquet(*[f"{self.path}/log/batch={b}/{kind}" for b in wanted])
        return read.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/", 1).cast("long"))

    def base(self) -> tuple[int, DataFrame]:
        """(last batch, rows) of the base as it stands; the rows come bucketed and sorted by txid."""
        found = self.versions()
        if not found:
            return -1, self.spark.createDataFrame([], ROW)
        v, upto, buckets, folder = found[-1]
        if self._named is None or self._named[0] != v:
            name = f"registrations_{uuid.uuid4().hex}"
            self.spark.sql(f"create table {name} ({ROW}) using parquet clustered by (txid) sorted by (txid) into {buckets} buckets location '{folder}'")
            self._named = (v, name)
        return upto, self.spark.table(self._named[1])

    # --- reading

    def _news(self, after: int, before: int | None) -> DataFrame:
        """txid, news (its added urls with their last tokens), since (the batch that first added one): bounded by the cap."""
        pairs = self._log("add", after, before).groupBy("txid", "url").agg(F.max_by("token", F.struct("batch", "seq")).alias("token"), F.min("batch").alias("since"))
        return pairs.groupBy("txid").agg(F.collect_list(F.struct("url", "token")).alias("news"), F.min("since").alias("since"))

    def nested(self, before: int | None = None) -> DataFrame:
        """txid, callbacks (url, token), expires_at as they stand (before a batch, if given). The log is shuffled into the
        base's buckets; the base is not shuffled."""
        upto, base = self.base()
        sets = self._log("ttl", upto, before).groupBy("txid").agg(F.array_sort(F.collect_set(F.struct("batch", "expires_at"))).alias("sets"))
        rows = base.withColumn("old", F.lit(True)).join(self._news(upto, before), "txid", "full").join(sets, "txid", "full")
        # of the expiries of a txid those count that were set while it was there, and of these the last
        last = F.try_element_at(F.filter("sets", lambda s: F.col("old").isNotNull() | (s["batch"] >= F.col("since"))), F.lit(-1))
        expires = F.when(last.isNotNull(), last["expires_at"]).otherwise(F.col("expires_at"))
        return rows.select("txid", _both().alias("callbacks"), expires.alias("expires_at")).where(F.size("callbacks") > 0)

    def state(self, before: int | None = None) -> DataFrame:
        """txid, url, token, expires_at as they stand (before a batch, if given)."""
        return self.nested(before).select("txid", F.inline("callbacks"), "expires_at").select("txid", "url", "token", "expires_at")

    def lookup(self, leaves: DataFrame, before: int | None = None) -> DataFrame:
        """leaves (txid and other columns) with url and token of everyone registered for them.

        Leaves that the sketch rules out go first. The others are shuffled into the base's buckets (or the base is broadcast,
        if it is small); the base is not."""
        upto, base = self.base()
        passes = self.may_hold(F.col("txid"), before)
        leaves = leaves if passes is None else leaves.where(passes)
        held = base.select("txid", "callbacks").join(leaves, "txid", "right").join(self._news(upto, before).drop("since"), "txid", "left")
        return held.select(*leaves.columns, F.inline(_both()))

    def sketch(self, before: int | None = None) -> tuple[int, DataFrame] | None:
        """(words, parts) of the Bloom sketch of all txids (before a batch); None if the table has none, or has no base."""
        found = self.versions()
        names = [n for n in self._names(f"{self.path}/sketch") if found and int(n.split("_")[0].partition("=")[2]) == found[-1][0]]
        if not names or not self._complete(f"{self.path}/sketch/{names[-1]}"):
            return None
        words = int(names[-1].partition("words=")[2])
        parts = self.spark.read.schema(bloom.SCHEMA).parquet(f"{self.path}/sketch/{names[-1]}")
        return words, parts.unionByName(bloom.sketch(self._log("add", found[-1][1], before), "txid", words))

    def may_hold(self, txid: Column, before: int | None = None) -> Column | None:
        """False only for txids that nobody registered; None if there is no sketch."""
        made = self.sketch(before)
        return None if made is None else bloom.may_hold(txid, made[1], made[0])

    # --- writing

    def _write(self, rows: DataFrame, batch: int, kind: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}/{kind}")

    def upsert(self, requests: DataFrame, batch: int, cap: int) -> DataFrame:
        """Store requests (txid, url, token, seq: their order) and give them back with status: 200, 400 for one without txid
        or url, or 429 for a url beyond the first `cap` of its txid. Replaying a batch changes nothing."""
        asked = requests.withColumn("_good", F.col("txid").isNotNull() & F.col("url").isNotNull())
        new = asked.where("_good").groupBy("txid", "url").agg(F.max_by("token", "seq").alias("token"), F.max("seq").alias("seq"), F.min("seq").alias("first"))
        # the urls that these txids have: found through the buckets, not by reading the table
        had = self.lookup(new.select("txid").distinct(), batch).select("txid", "url").withColumn("known", F.lit(True))
        both = new.join(had, ["txid", "url"], "full").withColumn("known", F.coalesce("known", F.lit(False)))
        slot = F.row_number().over(Window.partitionBy("txid").orderBy(F.desc("known"), "first", "url"))
        placed = both.withColumn("in", F.col("known") | (slot <= cap)).where(F.col("seq").isNotNull())
        out = f"{self.path}/log/batch={batch}"
        placed.select("txid", "url", "token", "seq", "in").write.mode("overwrite").parquet(f"{out}/asked")
        placed = self.spark.read.parquet(f"{out}/asked")
        self._write(placed.where("in").select("txid", "url", F.coalesce("token", F.lit("")).alias("token"), "seq"), batch, "add")
        answers = asked.join(placed.select("txid", "url", "in"), ["txid", "url"], "left")
        status = F.when(~F.col("_good"), 400).when(F.col("in"), 200).otherwise(429)
        return answers.withColumn("status", status).drop("_good", "in")

    def touch(self, txids: DataFrame, batch: int, expires_at: str | None | Column) -> None:
        """Set the expiry of txids (txid; expires_at may be an expression over their columns): what a mined block does to what
        it held. Unknown txids are passed over when read; of several expiries in one batch the last in time counts."""
        at = expires_at if isinstance(expires_at, Column) else F.lit(expires_at)
        self._write(txids.where("txid is not null").select("txid", at.cast("timestamp_ntz").alias("expires_at")).distinct(), batch, "ttl")

    def compact(self, now: str | None = None) -> None:
        """Fold the log into a new base version; with `now`, drop every txid whose expiry lies before it (a null one never
        does, and one that equals it has not yet)."""
        found = self.versions()
        batches = [int(n.partition("=")[2]) for n in self._names(f"{self.path}/log")]
        upto = max([*batches, *[f[1] for f in found]], default=-1)
        rows = self.nested(upto + 1)
        if now is not None:
            rows = rows.where(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now).cast("timestamp_ntz")))
        v, buckets = (found[-1][0] + 1, found[-1][2]) if found else (0, self.buckets)
        # an attempt that broke off has left a folder without _SUCCESS: its version is made again under the same name
        folder = f"{self.path}/base/v={v}_upto={upto}_buckets={buckets}"
        fs, p = self._fs(folder)
        fs.delete(p, True)
        name = f"registrations_{uuid.uuid4().hex}"
        one = rows.repartition(buckets, "txid")  # a file a bucket
        one.write.bucketBy(buckets, "txid").sortBy("txid").format("parquet").option("path", folder).saveAsTable(name)
        self._named = (v, name)
        if (words := bloom.words_for(self.spark.table(name).count())) is not None:
            bloom.sketch(self.spark.table(name), "txid", words).write.mode("overwrite").parquet(f"{self.path}/sketch/v={v}_words={words}")

    def vacuum(self) -> None:
        """Delete base versions but the last, and the log that it holds; not while readers of older versions run."""
        found = self.versions()
        if not found:
            return
        for _, _, _, folder in found[:-1]:
            fs, p = self._fs(folder)
            fs.delete(p, True)
        for name in self._names(f"{self.path}/log"):
            if int(name.partition("=")[2]) <= found[-1][1]:
                fs, p = self._fs(f"{self.path}/log/{name}")
                fs.delete(p, True)
