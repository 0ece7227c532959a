"""Communities, membership and writer matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prosegauge.operators.scale import first_rows, join_null_safe, running, top_per_group
from prosegauge.session import checkpointed

c = F.col


def _topics(df: DataFrame, name: str) -> Column:
    return F.coalesce(c(name), F.array().cast("array<string>"))


def list_communities(df: DataFrame, topic: str | None = None, visibility: str | None = None,
                     search: str | None = None, limit: int | None = 20, offset: int = 0) -> DataFrame:
    """Directory page, newest first. ``limit=None`` returns all matches (for the total count)."""
    if topic:
        df = df.filter((c("primary_topic") == topic) | F.array_contains(_topics(df, "secondary_topics"), topic))
    if visibility:
        df = df.filter(c("visibility") == visibility)
    if search:
        df = df.filter(c("name").ilike(f"%{search}%") | c("description").ilike(f"%{search}%"))
    return df if limit is None else df.orderBy(c("created_at").desc(), "id").offset(offset).limit(limit)


def community_page(df: DataFrame, limit: int = 20, after: tuple[object, object] | None = None, topic: str | None = None,
                   visibility: str | None = None, search: str | None = None) -> DataFrame:
    """A directory page behind a cursor, newest first, with ``total`` and the next page's cursor in every row.

    ``after`` is the (created_at, id) of the last row seen: rows before it are filtered out at the scan instead of being
    sorted and skipped, so the last page costs what the first one does. ``total`` counts all matches, whatever the page.
    ``next_created_at`` and ``next_id`` are NULL on the last page. NULL times come last, by id.
    """
    found = list_communities(df, topic, visibility, search, limit=None)
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    if after is not None:
        time, last = after
        known = c("created_at").isNotNull()
        behind = (~known & (c("id") > last)) if time is None else (
            ~known | (c("created_at") < F.lit(time)) | ((c("created_at") == F.lit(time)) & (c("id") > last)))
        found = found.filter(behind)
    # one row more than the page tells whether there is another page; the window holds only these
    some = found.orderBy(c("created_at").desc_nulls_last(), "id").limit(limit + 1).withColumn(
        "_at", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(c("created_at").desc_nulls_last(), "id")))
    every = W.partitionBy(F.lit(0))
    more = F.max("_at").over(every) > limit
    cursor = {f"next_{n}": F.when(more, F.max_by(n, F.when(c("_at") == limit, 1)).over(every)) for n in ("created_at", "id")}
    return some.withColumns(cursor).filter(c("_at") <= limit).drop("_at").withColumn("total", total)


def community_members(members: DataFrame, users: DataFrame) -> DataFrame:
    """Members with user attributes; a member without a user is dropped."""
    return members.join(users.select(c("id").alias("user_id"), "username", "avatar_url"), "user_id").select(
        "community_id", "user_id", "username", "role", "joined_at", "avatar_url")


def user_communities(communities: DataFrame, members: DataFrame) -> DataFrame:
    return members.select("user_id", c("community_id").alias("id")).join(communities, "id")


# --- matching -------------------------------------------------------------------------

def _ranking() -> list[Column]:
    return [F.coalesce("reputation_points", F.lit(0)).desc(), F.coalesce("total_submissions", F.lit(0)).desc(),
            c("user_id").asc()]


def like_minded_writers(writers: DataFrame, users: DataFrame, topic: str | None = None, style: str | None = None,
                        k: int = 20, targets: DataFrame | None = None) -> DataFrame:
    """Best ``k`` other writers for every target: 2 per shared topic, 1 for the wanted style.

    Topics come from a closed list, so there are few distinct topic sets. Scores
    are worked out between topic sets, each of which keeps its best k+1 writers;
    writers are never paired with writers.
    """
    active = users.filter(c("is_active") & c("email_verified")).select(c("id").alias("user_id"), "username")
    pool = writers.withColumn("primary_topics", _topics(writers, "primary_topics"))
    liked = F.coalesce(c("writing_style") == style, F.lit(False)) if style else F.lit(False)
    cands = pool.join(active, "user_id").withColumns({
        "_set": F.array_sort(F.array_distinct("primary_topics")), "_liked": liked})
    bucket = ["_set", "_liked"]
    leaders = top_per_group(cands, bucket, _ranking(), k + 1).drop("_rank")

    asked = (targets if targets is not None else writers.select("user_id")).select("user_id").distinct()
    own = join_null_safe(asked, pool.select("user_id", "primary_topics"), ["user_id"], "left")
    wanted = F.array(F.lit(topic)) if topic else _topics(own, "primary_topics")
    own = own.select(c("user_id").alias("target_id"), wanted.alias("_want"),
                     F.array_sort(F.array_distinct(wanted)).alias("_want_set"))
    sets = leaders.select(*bucket).distinct()
    wants = own.select("_want_set").distinct()
    # topic sets meet through a shared topic; "*" matches any set, "~" the sets of writers with the wanted style
    left = wants.select("_want_set", F.explode(F.concat("_want_set", F.array(
        F.when(F.size("_want_set") == 0, "*").otherwise("~")))).alias("_t"))
    right = sets.select(*bucket, F.explode(F.array_compact(F.concat("_set", F.array(
        F.lit("*"), F.when(c("_liked"), "~"))))).alias("_t"))
    met = left.join(right, "_t").select("_want_set", *bucket).distinct()
    shared = F.when(F.size("_want_set") == 0, F.size("_set")).otherwise(
        F.size(F.array_intersect("_want_set", "_set")))
    scored = met.withColumn("match_score", 2 * shared + c("_liked").cast("int")).filter("match_score > 0")
    ranked = scored.join(leaders, bucket)
    best = top_per_group(ranked, ["_want_set"], [c("match_score").desc(), *_ranking()], k + 1)
    page = own.join(best.drop("_rank"), "_want_set").filter(c("user_id") != c("target_id"))
    final = top_per_group(page, ["target_id"], [c("match_score").desc(), *_ranking()], k, rank="place")
    shared_topics = F.when(F.size("_want") == 0, c("primary_topics")).otherwise(
        F.filter("_want", lambda t: F.array_contains(c("primary_topics"), t)))
    reason = F.concat_ws("; ", F.when(F.size("shared_topics") > 0, F.concat(
        F.lit("same topic: "), F.array_join(F.slice("shared_topics", 1, 3), ", "))),
        F.when(c("_liked"), "similar writing style"))
    return final.withColumn("shared_topics", shared_topics).select(
        "target_id", "place", "user_id", "username", "writing_style", "shared_topics", "match_score",
        "reputation_points", "total_submissions", reason.alias("match_reason"))


def discover_communities(writers: DataFrame, communities: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` public communities by members for the first three topics of each writer.

    Writers without topics get the newest public ones. A community list is made
    once per distinct topic set from the best k of each topic.
    """
    public = communities.filter(c("visibility") == "public")
    by_size = [c("member_count").desc(), c("id").asc()]
    slim = public.select("id", "name", "member_count", F.explode(F.array_distinct(F.array_compact(F.concat(
        F.array("primary_topic"), _topics(public, "secondary_topics"))))).alias("_t"))
    leaders = top_per_group(slim, ["_t"], by_size, k).drop("_rank")
    asked = writers.select("user_id", F.array_sort(F.array_distinct(F.slice(
        _topics(writers, "primary_topics"), 1, 3))).alias("_set"))
    sets = asked.select("_set").distinct()
    matched = sets.select("_set", F.explode("_set").alias("_t")).join(leaders, "_t").drop("_t").distinct()
    lists = top_per_group(matched, ["_set"], by_size, k, rank="place")
    newest = (public.orderBy(c("created_at").desc(), c("id")).limit(k)
              .select(F.struct("created_at", "id", "name", "member_count").alias("e")))
    # k rows at most: numbered as one array, attached to the single empty topic set
    listed = newest.agg(F.sort_array(F.collect_list("e"), asc=False).alias("_all"))
    fallback = sets.filter(F.size("_set") == 0).select("_set", F.posexplode(listed.scalar()).alias("_p", "_e")).select(
        "_set", "_e.id", "_e.name", "_e.member_count", (c("_p") + 1).alias("place"))
    return asked.join(lists.select("_set", "id", "name", "member_count", "place").unionByName(fallback), "_set").select(
        "user_id", "place", c("id").alias("community_id"), "name", "member_count")


# --- membership (W13) and creation (W14) -----------------------------------------------------

def apply_membership(commands: DataFrame, members: DataFrame, communities: DataFrame) -> DataFrame:
    """Replay join and leave commands: ``accepted`` and ``reason`` of each.

    In a public community the state before a command is set by the previous
    command of the same user (owners always stay). Elsewhere nobody can join, so
    only an initial member's first leave counts.
    """
    pair, order = ["community_id", "user_id"], ["ts", "cmd_id"]
    leave = c("command") == "leave"
    seen = running(commands, pair, order, inclusive=False, maxima={
        "_last": F.struct("ts", "cmd_id", "command"),
        "_left": leave.cast("int"),
    })
    known = seen.join(communities.select(c("id").alias("community_id"), "visibility"), "community_id", "left")
    initial = members.select(*pair, "role", F.lit(True).alias("_member")).dropDuplicates(pair)
    state = known.join(initial, pair, "left")
    was, owner = F.coalesce(c("_member"), F.lit(False)), F.coalesce(c("role") == "owner", F.lit(False))
    public = c("visibility") == "public"
    member = F.when(owner, True).when(public, F.when(
        c("_last").isNull(), was).otherwise(c("_last.command") == "join")).otherwise(
        was & (F.coalesce(c("_left"), F.lit(0)) == 0))
    joined = state.withColumns({"_in": member, "_owner": owner})
    # Reply texts.
    reason = (
        F.when(leave, F.when(~c("_in"), "Not a member of this community")
               .when(c("_owner"), "Owner cannot leave. Transfer ownership first.")
               .otherwise("Successfully left community"))
        .when(c("visibility").isNull(), "Community not found")
        .when(c("_in"), "Already a member of this community")
        .when(~public, "This community is private. Request to join.")
        .otherwise("Successfully joined community"))
    out = joined.withColumn("reason", reason)
    return out.select(*commands.columns, c("reason").startswith("Successfully").alias("accepted"), "reason")


def member_counts(replayed: DataFrame, communities: DataFrame) -> DataFrame:
    """Member count of every community after the replay; never below 0."""
    change = replayed.filter("accepted").groupBy(c("community_id").alias("id")).agg(
        F.sum(F.when(c("command") == "join", 1).otherwise(-1)).alias("_d"))
    return communities.join(change, "id", "left").select(
        "id", F.greatest(F.lit(0), c("member_count") + F.coalesce("_d", F.lit(0))).alias("member_count"))


def apply_creations(commands: DataFrame, existing: DataFrame, unique: Sequence[str] = ("slug", "name")) -> DataFrame:
    """Accepted creations, first come first served, when every column of ``unique`` must be new.

    A rejected command frees its other values for later ones, so rounds are
    needed: a command that comes first for all its values is accepted, and what
    collides with it leaves. One round suffices where slug and name go together.
    """
    open_cmds = commands
    for u in unique:
        open_cmds = open_cmds.join(existing.select(u).distinct(), u, "left_anti")
    open_cmds = checkpointed(open_cmds.select(*commands.columns))
    accepted: DataFrame | None = None
    while not open_cmds.isEmpty():
        won = open_cmds
        for u in unique:
            firsts = open_cmds.groupBy(u).agg(F.min(F.struct("ts", "cmd_id")).alias("_f")).select(
                u, c("_f.cmd_id").alias("cmd_id"))
            won = won.join(firsts, [u, "cmd_id"], "left_semi")
        won = checkpointed(won.select(*commands.columns))
        accepted = won if accepted is None else accepted.unionByName(won)
        for u in unique:
            open_cmds = open_cmds.join(won.select(u), u, "left_anti")
        open_cmds = checkpointed(open_cmds.select(*commands.columns))
    return accepted if accepted is not None else open_cmds


def owner_rows(created: DataFrame) -> DataFrame:
    return created.select(c("id").alias("community_id"), c("creator_id").alias("user_id"),
                          F.lit("owner").alias("role"), c("ts").alias("joined_at"))


def first_creations(commands: DataFrame, existing: DataFrame, key: str = "slug") -> DataFrame:
    """Single-key form: the first command of each new key."""
    fresh = commands.join(existing.select(key).distinct(), key, "left_anti").select(*commands.columns)
    return first_rows(fresh, [c(key)], [c("ts"), c("cmd_id")])
