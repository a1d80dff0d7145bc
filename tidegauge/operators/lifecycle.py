"""Stages and topologies of requests as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.naming import delivery_topic, quality_topic, remedy_topic, selection_topic
from tidegauge.operators.lineage import cut
from tidegauge.operators.spread import spread

EDGE = (
    "request_id", "application_id", "parent", "child", "stage", "level", "is_source", "is_heal", "is_sink",
)

#: Steps that the topics behind some topics are followed by, before paths of all topics are doubled.
STEPS = 12


def _stages() -> Column:
    threshold = F.col("threshold_min").isNotNull() | F.col("threshold_max").isNotNull()
    return F.array_compact(
        F.array(
            F.lit("ingest"),
            F.when(threshold, F.lit("threshold")),
            F.when(F.col("obsrate_max").isNotNull(), F.lit("throttle")),
            F.lit("output"),
        )
    )


def request_stages(requests: DataFrame) -> DataFrame:
    """Stages of each request in order: request_id, position, stage.

    Ingest and output always; a threshold stage if a bound is given and a
    throttle stage if a maximum rate is.
    """
    return requests.select("request_id", F.posexplode(_stages()).alias("position", "stage"))


def stage_edges(requests: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Edge table: every stage leads from its parent topic to its child topic.

    A request for topic ALL has one ingest edge per registered topic
    (``topics``, column ``topic``). The level of a child is one more than that
    of its parent; sources have level 0.
    """
    stages = _stages()
    listed = requests.select(
        "request_id",
        "application_id",
        "topic",
        F.coalesce(F.col("area"), F.lit("ALL")).alias("area"),
        "obs_level",
        F.size(stages).alias("_n"),
        F.posexplode(stages).alias("_pos", "stage"),
    )

    def behind(position: Column) -> Column:
        """Name of the topic behind the stage at a position."""
        app, req = F.col("application_id"), F.col("request_id")
        return (
            F.when(position < 0, F.col("topic"))
            .when(position == F.col("_n") - 1, delivery_topic(app, req))
            .when(position == 0, selection_topic(F.col("topic"), F.col("area"), F.col("obs_level")))
            .otherwise(quality_topic(app, req, position))
        )

    pos = F.col("_pos")
    edges = listed.select(
        "request_id",
        "application_id",
        behind(pos - 1).alias("parent"),
        behind(pos).alias("child"),
        "stage",
        (pos + 1).alias("level"),
        (pos == 0).alias("is_source"),
        F.lit(False).alias("is_heal"),
        (pos == F.col("_n") - 1).alias("is_sink"),
    )
    if topics is None:
        return edges
    names = F.explode(F.array(F.col("topic"), F.lit("ALL"))).alias("parent")
    every = topics.select("topic").distinct().select(F.col("topic").alias("_each"), names)
    fanned = edges.join(every, "parent", "left")
    parent = F.when(F.col("is_source"), F.coalesce("_each", "parent")).otherwise(F.col("parent"))
    return fanned.withColumn("parent", parent).select(*EDGE)


def primary_sources(edges: DataFrame) -> DataFrame:
    return edges.where("is_source").select("request_id", F.col("parent").alias("topic")).distinct()


def final_sinks(edges: DataFrame) -> DataFrame:
    return edges.where("is_sink").select("request_id", F.col("child").alias("topic")).distinct()


def sharing_roots(shared: DataFrame, most_rounds: int = 40) -> DataFrame:
    """request_id, root of the requests that share another one: the first of the line, which built the chain.

    ``shared``: request_id, shared_with. Each round every request looks up where the
    one that it points at points, so that a line of any length closes in a
    logarithmic number of joins. Requests that share each other in a circle have no
    root, which is an error.
    """
    links = shared.where(F.col("shared_with").isNotNull() & (F.col("shared_with") != F.col("request_id")))
    found = cut(links.groupBy("request_id").agg(F.min("shared_with").alias("root")))
    for _ in range(most_rounds):
        further = found.select(F.col("request_id").alias("root"), F.col("root").alias("_next"))
        looked = cut(found.join(further, "root", "left"))
        if looked.where(F.col("_next").isNotNull()).isEmpty():
            return looked.select("request_id", "root")
        found = looked.select("request_id", F.coalesce("_next", "root").alias("root"))
    raise ValueError("some requests share each other in a circle")


def shared_edges(edges: DataFrame, shared: DataFrame) -> DataFrame:
    """Edges after sharing: a request equal to an enforced one only keeps its own output.

    ``shared`` is the result of ``find_shared_requests``, or of several of them. The
    output then starts at the last topic before the sink of the other request, or,
    where that one shares a third, of the first in line, whose stages are all that run.
    """
    links = shared.where(F.col("shared_with").isNotNull()).join(sharing_roots(shared), "request_id")
    last = edges.where("is_sink").select(F.col("request_id").alias("root"), F.col("parent").alias("_from"))
    reuse = links.join(last, "root").select("request_id", "_from", "shared_with")
    marked = edges.join(reuse, "request_id", "left")
    own = F.col("shared_with").isNull()
    kept = marked.where(own | F.col("is_sink"))
    return kept.select(
        "request_id",
        "application_id",
        F.when(own, F.col("parent")).otherwise(F.col("_from")).alias("parent"),
        "child",
        "stage",
        F.when(own, F.col("level")).otherwise(F.lit(1)).alias("level"),
        F.when(own, F.col("is_source")).otherwise(F.lit(True)).alias("is_source"),
        "is_heal",
        "is_sink",
        F.col("shared_with").alias("constructed_from"),
    )


def upstream_topics(edges: DataFrame, most_rounds: int = 40, starts: DataFrame | None = None) -> DataFrame:
    """topic, upstream: every topic with itself and all topics that reach it through stages.

    With ``starts`` (column ``topic``) only for these topics: they are followed step by
    step, and where that takes more than ``STEPS`` by paths of all topics. Paths double
    in each round, so that chains of any length and chains built on chains close in a
    logarithmic number of joins.
    """
    links = edges.select(F.col("child").alias("topic"), F.col("parent").alias("upstream")).distinct()
    if starts is not None:
        asked = starts.select("topic").distinct()
        own = asked.select("topic", F.col("topic").alias("upstream"))
        reach = cut(own.unionByName(links.join(asked, "topic", "left_semi")).distinct())
        ends = reach.where("topic <> upstream")
        step = links.select(F.col("topic").alias("upstream"), F.col("upstream").alias("_beyond"))
        for _ in range(STEPS):
            if ends.isEmpty():
                return reach
            beyond = ends.join(step, "upstream").select("topic", F.col("_beyond").alias("upstream")).distinct()
            ends = cut(beyond.join(reach, ["topic", "upstream"], "left_anti"))
            reach = reach.unionByName(ends)
        return upstream_topics(edges, most_rounds).join(asked, "topic", "left_semi")
    reach = cut(links.unionByName(links.select("topic", F.col("topic").alias("upstream"))).distinct())
    for _ in range(most_rounds):
        further = reach.select(F.col("topic").alias("upstream"), F.col("upstream").alias("_beyond"))
        grown = reach.join(further, "upstream").select("topic", F.col("_beyond").alias("upstream"))
        grown = cut(reach.unionByName(grown).distinct())
        if grown.count() == reach.count():
            return grown
        reach = grown
    raise ValueError("paths between topics still grow")


def _read_from_others(edges: DataFrame) -> DataFrame:
    """request_id, topic: topics made by stages that a request's stages read, and that none of its own makes."""
    named = edges.select("request_id", "parent", "child")
    of_request = named.groupBy("request_id").agg(F.collect_set("parent").alias("_read"), F.collect_set("child").alias("_made"))
    read = of_request.select("request_id", F.explode(F.array_except("_read", "_made")).alias("topic"))
    # a topic that others also make from something else leads on to what these read
    several = named.groupBy(F.col("child").alias("topic")).agg(F.min("parent").alias("_low"), F.max("parent").alias("_high"))
    several = several.where("_low <> _high").select("topic")
    beside = named.join(several, F.col("child") == F.col("topic"), "left_semi")
    sources = beside.select(F.col("child").alias("_child"), F.col("parent").alias("topic")).distinct()
    others = beside.select("request_id", "child").distinct().join(sources, F.col("child") == F.col("_child"))
    made = edges.select(F.col("child").alias("topic")).distinct()
    return read.unionByName(others.select("request_id", "topic")).join(made, "topic", "left_semi").distinct()


def stage_users(edges: DataFrame) -> DataFrame:
    """parent, child, stage, request_id: every request with each stage instance that its output depends on.

    These are its own stages and, if it was constructed from another request, the
    stages behind the topic that it reads: that request's up to its own output, and
    so on for requests constructed from requests. They are found along topics, so
    that they hold although a request between was deleted. Only topics that a request
    reads from others are followed, as it has the stages behind its own topics itself.
    """
    edges = cut(edges.select("request_id", "parent", "child", "stage"))
    stages = edges.select("parent", "child", "stage").distinct()
    entries = cut(_read_from_others(edges))
    behind = upstream_topics(edges, starts=entries.select("topic"))
    further = entries.join(behind, "topic").select("request_id", F.col("upstream").alias("child"))
    read = edges.select("request_id", "child").unionByName(further).distinct()
    return stages.join(read, "child").select("parent", "child", "stage", "request_id")


def stage_usage(edges: DataFrame) -> DataFrame:
    """How many requests use each stage instance (its topics and name), those built on another request included."""
    return stage_users(edges).groupBy("parent", "child", "stage").agg(F.countDistinct("request_id").alias("uses"))


def releasable_stages(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Stage instances that nobody uses once the ``deleted`` requests are gone."""
    gone = deleted.select("request_id").distinct().withColumn("_gone", F.lit(True))
    marked = stage_users(edges).join(gone, "request_id", "left")
    left = F.sum(F.when(F.col("_gone").isNull(), F.lit(1)).otherwise(F.lit(0)))
    return marked.groupBy("parent", "child", "stage").agg(left.alias("_left")).where("_left = 0").drop("_left")


def insert_heal_stage(edges: DataFrame, heals: DataFrame) -> DataFrame:
    """Put the remedy between the last stage and the sink of the healed requests.

    ``heals``: request_id, remedy. The old output stage now feeds the remedy
    topic and the remedy feeds the sink.
    """
    one = spread(heals.select("request_id", "remedy"), "request_id").groupBy("request_id").agg(F.min("remedy").alias("_remedy"))
    marked = edges.join(one, "request_id", "left")
    healing = F.col("is_sink") & F.col("_remedy").isNotNull()
    middle = remedy_topic(F.col("application_id"), F.col("request_id"), F.col("_remedy"))
    same = F.struct("parent", "child", "stage", "level", "is_source", "is_heal", "is_sink")
    first = F.struct(
        F.col("parent"), middle.alias("child"), F.col("stage"), F.col("level"), F.col("is_source"),
        F.lit(True).alias("is_heal"), F.lit(False).alias("is_sink"),
    )
    second = F.struct(
        middle.alias("parent"), F.col("child"), F.col("_remedy").alias("stage"), (F.col("level") + 1).alias("level"),
        F.lit(False).alias("is_source"), F.lit(False).alias("is_heal"), F.lit(True).alias("is_sink"),
    )
    rows = F.when(healing, F.array(first, second)).otherwise(F.array(same))
    return marked.select("request_id", "application_id", F.inline(rows)).select(*EDGE)


def remove_heal_stage(edges: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Undo :func:`insert_heal_stage`, for all healed requests or the given ones."""
    window = Window.partitionBy("request_id")
    healed = F.max("is_heal").over(window)
    if requests is not None:
        chosen = requests.select("request_id").distinct().withColumn("_chosen", F.lit(True))
        marked = edges.join(chosen, "request_id", "left").withColumn("_undo", healed & F.coalesce("_chosen", F.lit(False)))
    else:
        marked = edges.withColumn("_undo", healed)
    sink = F.max(F.when(F.col("is_sink"), F.col("child"))).over(window)
    widened = marked.withColumn("_sink", sink)
    kept = widened.where(~(F.col("_undo") & F.col("is_sink")))
    back = F.col("_undo") & F.col("is_heal")
    return kept.select(
        "request_id",
        "application_id",
        "parent",
        F.when(back, F.col("_sink")).otherwise(F.col("child")).alias("child"),
        "stage",
        "level",
        "is_source",
        F.when(back, F.lit(False)).otherwise(F.col("is_heal")).alias("is_heal"),
        (F.col("is_sink") | back).alias("is_sink"),
    )


def downstream_of(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Topics after a given one up to the sink: request_id, topic, level.

    ``starts``: request_id, topic. Chains are linear behind the ingest stage,
    so later topics are those with a higher level.
    """
    nodes = edges.select("request_id", F.col("child").alias("topic"), "level").unionByName(
        edges.where("is_source").select("request_id", F.col("parent").alias("topic"), F.lit(0).alias("level"))
    ).distinct()
    begin = starts.join(nodes, ["request_id", "topic"]).groupBy("request_id").agg(F.min("level").alias("_from"))
    return nodes.join(begin, "request_id").where(F.col("level") > F.col("_from")).select("request_id", "topic", "level")


def dependents(shared: DataFrame) -> DataFrame:
    """Requests built from another one, one row each: request_id, dependent_request."""
    used = shared.where(F.col("shared_with").isNotNull())
    return used.select(
        F.col("shared_with").alias("request_id"), F.col("request_id").alias("dependent_request")
    ).distinct()


def dependent_counts(shared: DataFrame) -> DataFrame:
    return dependents(shared).groupBy("request_id").agg(F.count(F.lit(1)).alias("dependents"))
