"""New-record detection, merging and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.text import blank_to_null, squash
from noticeloom.functions.values import notice_hash, notice_url
from noticeloom.session import cut

#: What a page says in each language's slice.
SLICE = ("summary", "remedy", "consequence", "component")


def present(c: Column) -> Column:
    """A key as text, null if blank, so that blank keys never match."""
    return F.nullif(F.btrim(c.cast("string")), F.lit(""))


#: A batch of at most so many keys (some tens of MB) is sent to the tasks that scan what is stored.
BATCH_KEYS = 400_000


def matching(stored: DataFrame, keys: DataFrame, key: str, limit: int = BATCH_KEYS) -> DataFrame:
    """The stored rows with a key of a batch. A small batch is broadcast, once counted, so that the stored side is scanned where it lies and not shuffled."""
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    small = wanted.limit(limit + 1).count() <= limit
    return stored.join(F.broadcast(wanted) if small else wanted, key, "left_semi")


def merge_details(rows: DataFrame, details: DataFrame, key: str, fields: Sequence[str], lists: dict[str, str] | None = None) -> DataFrame:
    """Listing rows with a detail page; per field the detail's value, else the listing's.

    ``lists`` names array columns of the details that begin with the chosen value of a field, once.
    Rows whose detail page is missing drop out.
    """
    both = rows.alias("r").join(details.alias("d"), F.col(f"r.{key}") == F.col(f"d.{key}"), "inner")
    pick = lambda f: F.coalesce(blank_to_null(F.col(f"d.{f}")), F.col(f"r.{f}"))
    arrays = [
        F.array_distinct(F.filter(F.concat(F.array(pick(f)), F.coalesce(F.col(f"d.{name}"), F.array().cast("array<string>"))), lambda x: squash(x) != "")).alias(name)
        for name, f in (lists or {}).items()
    ]
    return both.select(F.col(f"r.{key}").alias(key), *[pick(f).alias(f) for f in fields], *arrays)


def new_records(records: DataFrame, stored: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Records that match no stored one by any of the keys.

    One anti join a key, each an equi-join, where a join on ``a = b or c = d`` would compare all
    pairs. Blank keys never match.
    """
    for own, theirs in keys:
        seen = stored.select(present(F.col(theirs)).alias("seen_key")).where("seen_key is not null").distinct()
        records = records.join(seen, present(F.col(own)) == F.col("seen_key"), "left_anti")
    return records


def new_notices(rows: DataFrame, stored: DataFrame, hashes: DataFrame, url: str = "url", date: str | None = None) -> DataFrame:
    """Notices stored neither by address nor by hash; undated ones wait once any stored row is dated."""
    seen = stored.select(notice_url(F.col(url)).alias("seen_url")).where("seen_url <> ''").distinct()
    out = rows.join(seen, notice_url(F.col(url)) == F.col("seen_url"), "left_anti")
    out = out.join(hashes.select(F.col("hash").alias("seen_hash")).distinct(), notice_hash(notice_url(F.col(url))) == F.col("seen_hash"), "left_anti")
    if date and date in stored.columns and not stored.where(F.col(date).isNotNull()).isEmpty():
        out = out.where(F.col(date).isNotNull())
    return out


def vehicle_campaigns(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Landed campaign rows renamed and trimmed; make and model upper-cased; the number required."""
    out = raw.select(*[F.btrim(F.col(old).cast("string")).alias(new) for new, old in names.items()])
    for c in ("make", "model"):
        out = out.withColumn(c, F.upper(c)) if c in out.columns else out
    return out.where("campaignNumber is not null and campaignNumber <> ''")


def campaigns_of(vehicles: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Campaigns of each vehicle by upper-cased make and model, and year."""
    own = vehicles.withColumn("make", F.upper(F.btrim("make"))).withColumn("model", F.upper(F.btrim("model")))
    return own.join(campaigns, ["make", "model", "year"])


#: Up to so many pairs of numbers, or of a number and a short text, are sent to the tasks (some 100 MB).
SENT_PAIRS = 2_000_000
#: Consecutive rows of a task that meet in one list at most, as a power of two.
LIST_BITS = 18
#: So many rows stand beside a campaign in turn: long enough that a file names it once for them, short enough that the rows' repetition is seen by its compression.
IN_TURN = 64


def packed(df: DataFrame, key: str, columns: Sequence[str], name: str) -> DataFrame:
    """Rows of a key in lists of structs. Lists are made where the rows lie; a key has one for each task and ``2 ** LIST_BITS`` rows, so none grows with the table."""
    piece = F.shiftright(F.monotonically_increasing_id(), LIST_BITS)
    return df.select(key, F.struct(*columns).alias(name), piece.alias("piece")).groupBy(key, "piece").agg(F.collect_list(name).alias(name)).drop("piece")


def campaigns_of_rows(rows: DataFrame, vehicles: DataFrame, campaigns: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """J4 for very many rows that name a vehicle by a key: the ``columns`` of each, with the number of each campaign.

    Make, model and year become a number first, rows and campaigns of the same number are packed into lists, and lists meet, not
    rows. The result, which may be hundreds of times the rows, is made last and passes no shuffle; a campaign stands beside all rows of a
    list in turn, so that a file of it stays small. Sides that are small, once counted, are sent to the tasks.
    """
    kinds = cut(campaigns.select("make", "model", "year").distinct().withColumn("kind", F.monotonically_increasing_id()))
    small = lambda df: F.broadcast(df) if df.limit(SENT_PAIRS + 1).count() <= SENT_PAIRS else df
    of_key = vehicles.select(key, F.upper(F.btrim("make")).alias("make"), F.upper(F.btrim("model")).alias("model"), "year").join(kinds, ["make", "model", "year"]).select(key, "kind")
    numbered = campaigns.join(kinds, ["make", "model", "year"]).select("kind", "campaignNumber")
    few = numbered.limit(SENT_PAIRS + 1).count() <= SENT_PAIRS
    numbers = packed(numbered, "kind", ["campaignNumber"], "campaigns")
    lists = packed(rows.select(key, *columns).join(small(of_key), key), "kind", columns, "rows")
    starts = F.sequence(F.lit(1), F.size("rows"), F.lit(IN_TURN))
    turns = lists.select("kind", F.explode(F.transform(starts, lambda i: F.slice("rows", i, F.lit(IN_TURN)))).alias("rows"))
    met = turns.join(F.broadcast(numbers) if few else numbers, "kind")
    each = met.select("rows", F.explode("campaigns").alias("campaign")).select(F.explode("rows").alias("row"), F.col("campaign.campaignNumber").alias("campaignNumber"))
    return each.select(*[F.col("row")[c].alias(c) for c in columns], "campaignNumber")


def asked_campaigns(vehicles: DataFrame, campaigns: DataFrame) -> DataFrame:
    """J4 where the vehicles themselves are not shown: each campaign that is asked for, with the number of its ``vehicles``.

    Equal vehicles meet a campaign as one, so that what follows is done once a campaign; ``repeated`` makes the rows in the end.
    """
    own = vehicles.groupBy(F.upper(F.btrim("make")).alias("make"), F.upper(F.btrim("model")).alias("model"), "year").agg(F.count(F.lit(1)).alias("vehicles"))
    return campaigns.join(own, ["make", "model", "year"])


#: So many copies of a row are made in one go.
COPIES = 1024


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as the column ``times`` says, without that column.

    Few rows may become very many, and one of them most, so they are dealt over the tasks in pieces of ``COPIES`` first.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in df.columns if c != times]
    pieces = df.where(F.col(times) > 0).select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / COPIES))).alias("piece"))
    dealt = pieces.select(*columns, F.least(F.lit(COPIES), F.col(times) - F.col("piece") * COPIES).cast("int").alias("copies")).repartition(n)
    return dealt.select(*columns, F.explode(F.array_repeat(F.lit(True), F.col("copies"))).alias("copy")).select(*columns)


def stored_or_raw(raw: DataFrame, stored: DataFrame, key: str, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The stored row wins whole, else the raw one; ``is_stored`` tells which. Columns to ``keep`` pass unchanged.

    Stored rows must be unique by the key.
    """
    there = stored.select(F.col(key).alias("stored_key"), *[F.col(f).alias(f"stored_{f}") for f in fields])
    both = raw.join(there, F.col(key) == F.col("stored_key"), "left")
    hit = F.col("stored_key").isNotNull()
    return both.select(key, *keep, *[F.when(hit, F.col(f"stored_{f}")).otherwise(F.col(f)).alias(f) for f in fields], hit.alias("is_stored"))


def enrichment_backlog(raw: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys still to be enriched, once each."""
    return raw.select(key).distinct().join(stored.select(key), key, "left_anti")


def translation_backlog(recalls: DataFrame, key: str, languages: Sequence[str]) -> DataFrame:
    """(recall, language) without a complete entry in the ``languages`` map.

    Summary and remedy must be there; consequence and component only if English has them.
    """
    rows = recalls.withColumn("lang", F.explode(F.array(*[F.lit(x) for x in languages])))
    own, english = F.try_element_at("languages", F.col("lang")), F.try_element_at("languages", F.lit("en"))
    has = lambda s, f: F.coalesce(squash(s[f]) != "", F.lit(False))
    done = has(own, "summary") & has(own, "remedy")
    for f in ("consequence", "component"):
        done = done & (~has(english, f) | has(own, f))
    return rows.where(~done).select(key, "lang")


def image_reuse(images: DataFrame, by_url: DataFrame, by_hash: DataFrame) -> DataFrame:
    """The file of an image already mapped by address, else stored with the same content, else none yet."""
    urls = by_url.select(F.col("url").alias("known_url"), F.col("filename").alias("url_file"))
    hashes = by_hash.select(F.col("hash").alias("known_hash"), F.col("filename").alias("hash_file"))
    out = images.join(urls, F.col("url") == F.col("known_url"), "left").join(hashes, F.col("hash") == F.col("known_hash"), "left")
    status = F.when(F.col("url_file").isNotNull(), "mapped").when(F.col("hash_file").isNotNull(), "reused").otherwise("to convert")
    return out.select("url", "hash", F.coalesce("url_file", "hash_file").alias("filename"), status.alias("status"))


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a table of keys."""
    return df.join(keys.select(key).distinct(), key, "left_semi")
