"""Chart records whose state runs over all weeks, and records of one artist on several charts; SQL and DataFrames are written apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtide.operators import charts as C
from playtide.operators.ranking import ranked_by
from playtide.operators.scans import running_max
from playtide.plans.base import query
from playtide.plans.charts import CHART_SQL, KINDS, _score_sql, weekly
from playtide.plans.charts import frames as read_frames
from playtide.plans.charts import written_frames as frames
from playtide.sources.publish import scratch


def weeks_so_far(chart: DataFrame) -> DataFrame:
    """entity, week, so_far, best: weeks charted up to each row, and the most of any entity in the weeks before.

    The state is carried over the weeks' greatest values, by ranges of the weeks.
    """
    own = chart.select("entity", "week", F.row_number().over(Window.partitionBy("entity").orderBy("week")).cast("long").alias("so_far"))
    tops = own.groupBy("week").agg(F.max("so_far").alias("top"))
    best = running_max(tops, F.col("top"), "best", F.asc("week"))
    return own.join(best.select("week", "best"), "week")


_SO_FAR = """select {what} from (select entity, week, so_far, max(so_far) over (order by week range between unbounded preceding and 1 preceding) as best
from (select entity, week, row_number() over (partition by entity order by week) as so_far from w_{k}) r) x where {where}"""


def _state(kind: str, where: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: weeks_so_far(weekly(kind)(spark, sf_dir)).where(where).selectExpr(*columns)


for _k in KINDS:
    for _name, _what, _where in (
        ("weeks", "entity, week, so_far", "so_far > best"), ("tied", "entity, week, so_far", "so_far = best"), ("watch", "entity, week, best - so_far as missing", "best - so_far between 1 and 2 and so_far >= 5"),
    ):
        query(f"feed_record_{_name}_{_k}", CHART_SQL + " " + _SO_FAR.format(what=_what, k=_k, where=_where))(_state(_k, _where, *_what.split(", ")))


def main_artists(cp: DataFrame, entity: str) -> DataFrame:
    """(entity, artist_id): the artist with the most plays of each; the smallest id of several."""
    plays = cp.groupBy(entity, "artist_id").agg(F.sum("plays").alias("n"))
    return plays.groupBy(F.col(entity).alias("entity")).agg(F.min(F.struct((-F.col("n")).alias("n"), "artist_id")).alias("b")).select("entity", F.col("b.artist_id").alias("artist_id"))


_MAIN = """select {k}_id as entity, artist_id from (select {k}_id, artist_id, row_number() over (partition by {k}_id order by sum(plays) desc, artist_id) as n from cp group by {k}_id, artist_id) where n = 1"""


@query("record_double_debut", CHART_SQL + f""" select a.first_week as week, ta.artist_id, a.entity as track_id, b.entity as album_id
from sum_track a join ({_MAIN.format(k="track")}) ta on ta.entity = a.entity join sum_album b on b.first_week = a.first_week join ({_MAIN.format(k="album")}) al on al.entity = b.entity and al.artist_id = ta.artist_id
where a.debut_no1 and b.debut_no1""")
def record_double_debut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track and an album of one main artist that both enter at number one in the same week."""
    f = frames(spark, sf_dir)
    first = lambda k: f[f"sum_{k}"].where("debut_no1").join(main_artists(f["cp"], f"{k}_id"), "entity").select(F.col("first_week").alias("week"), "artist_id", F.col("entity").alias(f"{k}_id"))
    return first("track").join(first("album"), ["week", "artist_id"])


@query("record_triple_no1", CHART_SQL + f""" select t.week, r.entity as artist_id, t.entity as track_id, a.entity as album_id
from w_track t join w_album a on a.week = t.week and a.rank = 1 join ({_MAIN.format(k="album")}) m on m.entity = a.entity join w_artist r on r.week = t.week and r.rank = 1 and r.entity = m.artist_id
where t.rank = 1 and exists (select 1 from cp where cp.track_id = t.entity and cp.artist_id = r.entity)""")
def record_triple_no1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks in which one artist leads the artists, made the leading album and has a credit on the leading track."""
    f = frames(spark, sf_dir)
    top = lambda k: f[f"w_{k}"].where("rank = 1").select("week", F.col("entity").alias(f"{k}_id"))
    album = top("album").join(main_artists(f["cp"], "album_id"), F.col("album_id") == F.col("entity")).drop("entity")
    led = scratch(top("artist").join(album, ["week", "artist_id"]).join(top("track"), "week"))  # a row a week at most
    credits = f["cp"].select("track_id", "artist_id").join(F.broadcast(led.select("track_id", "artist_id").distinct()), ["track_id", "artist_id"], "left_semi").distinct()
    return led.join(credits, ["track_id", "artist_id"]).select("week", "artist_id", "track_id", "album_id")


def track_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.power_scores(weekly("track")(spark, sf_dir), "track")


def cross_power(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Summed power of an album's or artist's tracks, with its rank among all."""
        people = read_frames(spark, sf_dir)["cp"].select(F.col("track_id").alias("entity"), f"{kind}_id").distinct()
        total = track_scores(spark, sf_dir).join(people, "entity").groupBy(f"{kind}_id").agg(F.sum("power").alias("power"), F.count(F.lit(1)).alias("tracks"))
        return ranked_by(total, "place", "power").select(f"{kind}_id", "power", "tracks", "place")

    return run


for _k in ("album", "artist"):
    query(f"cross_power_{_k}", CHART_SQL + _score_sql("track") + f""" select c.{_k}_id, cast(sum(p.power) as bigint) as power, count(*) as tracks, rank() over (order by sum(p.power) desc) as place
from scores p join (select distinct track_id, {_k}_id from cp) c on c.track_id = p.entity group by c.{_k}_id""")(cross_power(_k))


@query("chart_honors", CHART_SQL + _score_sql("track") + """ select award, entity from (
 select 'power' as award, entity, row_number() over (order by power desc, entity) as n from scores union all
 select 'weeks', entity, row_number() over (order by weeks desc, entity) from scores union all
 select 'peak', entity, row_number() over (order by peak, weeks_at_peak desc, entity) from scores union all
 select 'no1 weeks', entity, row_number() over (order by no1_weeks desc, entity) from scores) x where n = 1""")
def chart_honors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track that leads each award, by one pre-aggregated minimum."""
    orders = {"power": [-F.col("power")], "weeks": [-F.col("weeks")], "peak": [F.col("peak"), -F.col("weeks_at_peak")], "no1 weeks": [-F.col("no1_weeks")]}
    best = [F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(o)], F.col("entity"))).alias(f"a{n}") for n, o in enumerate(orders.values())]
    row = track_scores(spark, sf_dir).agg(*best)
    awards = F.array(*[F.struct(F.lit(a).alias("award"), F.col(f"a{n}.entity").alias("entity")) for n, a in enumerate(orders)])
    return row.select(F.explode(awards).alias("r")).select("r.*").where("entity is not null")
