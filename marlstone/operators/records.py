"""Personal records: credit audit, terms, timetables, enrichment, groups, manifests, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import sinks

PASSED = ("及格", "抵免")
FAILED = ("不及格", "停修", "未完成")
#: Credits required in total, of compulsory, elective and general courses, unless rules say otherwise.
TOTAL, COMPULSORY, ELECTIVE, GENERAL = 130, 65, 49, 16
DAYS, PERIODS = 7, 13


def whole_number(text: Column) -> Column:
    """'3', '3.0' to 3; anything else to null."""
    return text.try_cast("double").cast("int")


def requirements(rules: DataFrame) -> DataFrame:
    """Required credits by kind from rules (category, credits): compulsory is the sum of its parts, 65 if that is zero or absent."""
    parts = F.sum(F.when(F.col("category").isin("共同必修", "院必修", "系必修"), F.col("credits")))
    return rules.agg(F.coalesce(F.nullif(parts, F.lit(0)), F.lit(COMPULSORY)).cast("long").alias("compulsory")).select("compulsory", F.lit(ELECTIVE).alias("elective"), F.lit(GENERAL).alias("general"), F.lit(TOTAL).alias("total"))


def _pieces(name: Column, sizes: tuple[int, ...]) -> Column:
    """The distinct pieces of a name that have one of some sizes."""
    of = lambda k: F.when(F.length(name) >= k, F.transform(F.sequence(F.lit(1), F.length(name) - (k - 1)), lambda i: F.substring(name, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(k) for k in sizes]))


def contained(inner: DataFrame, outer: DataFrame, *scope: str) -> DataFrame:
    """The columns ``scope``, inner and outer of the distinct pairs where the text ``inner`` (null and empty: none) stands within ``outer`` of the same scope.

    Whatever stands within a text has all its three-character pieces there (a shorter one is a piece itself).  Each inner text meets the outer ones
    by that of its pieces which the fewest of these hold, so a piece that nearly all share, like a common opening, pairs nothing.
    """
    within = outer.where("outer IS NOT NULL").select(*scope, "outer").distinct()
    held = sinks.kept(within.withColumn("gram", F.explode(_pieces(F.col("outer"), (1, 2, 3)))), "grams")
    often = held.groupBy(*scope, "gram").agg(F.count("*").alias("n"))
    own = F.when(F.length("inner") >= 3, _pieces(F.col("inner"), (3,))).otherwise(F.array("inner"))
    asked = inner.where("inner <> ''").select(*scope, "inner").distinct().withColumn("gram", F.explode(own))
    rarest = asked.join(often, [*scope, "gram"], "left").groupBy(*scope, "inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    met = rarest.where("rarest.n > 0").select(*scope, "inner", F.col("rarest.gram").alias("gram")).join(held, [*scope, "gram"])
    return met.where(F.col("outer").contains(F.col("inner"))).select(*scope, "inner", "outer")


def either_way(left: DataFrame, right: DataFrame, name: str, other: str, *scope: str) -> DataFrame:
    """The distinct pairs of texts left.name and right.other of which one stands within the other."""
    side = lambda rows, column, role: rows.select(*scope, F.col(column).alias(role))
    holds = contained(side(right, other, "inner"), side(left, name, "outer"), *scope).select(*scope, F.col("outer").alias(name), F.col("inner").alias(other))
    held = contained(side(left, name, "inner"), side(right, other, "outer"), *scope).select(*scope, F.col("inner").alias(name), F.col("outer").alias(other))
    return holds.union(held).distinct()


def own_required(courses: DataFrame, rules: DataFrame) -> DataFrame:
    """courses with ``own``: a rule course of the student's department is in the name or the other way round; a name without rules is not of its own."""
    hits = either_way(courses, rules, "name", "rule_course", "dept").select("dept", "name").distinct()
    return courses.join(hits.withColumn("own", F.lit(True)), ["dept", "name"], "left").select(*courses.columns, F.coalesce("own", F.lit(False)).alias("own"))


def audit(courses: DataFrame) -> DataFrame:
    """Credits earned by kind for each student; compulsory courses of other departments count as elective, once."""
    kind = F.when((F.col("type") == "必") & ~F.col("own"), "選").otherwise(F.col("type"))
    earned = lambda k: F.coalesce(F.sum(F.when(kind == k, F.col("credits"))), F.lit(0)).cast("long")
    done = courses.where(F.col("status").isin(*PASSED)).groupBy("student").agg(earned("必").alias("compulsory"), earned("選").alias("elective"), earned("通").alias("general"), F.sum("credits").cast("long").alias("earned"))
    return done.withColumn("remaining", F.greatest(F.lit(0).cast("long"), TOTAL - F.col("earned")))


def ongoing(courses: DataFrame) -> DataFrame:
    """Credits under way in each student's last term."""
    last = courses.groupBy("student").agg(F.max("term").alias("term"))
    return courses.join(last, ["student", "term"]).where("status = '修課中'").groupBy("student", "term").agg(F.sum("credits").cast("long").alias("credits"))


def term_histogram(courses: DataFrame) -> DataFrame:
    """Courses by outcome, credits and the first six names of each term."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    first = F.when(F.col("__n") <= 6, F.struct("orderkey", "pos", "name"))
    names = F.transform(F.array_sort(F.collect_list(first)), lambda x: x["name"])
    place = F.row_number().over(Window.partitionBy("student", "term").orderBy("orderkey", "pos", "name"))
    return courses.withColumn("__n", place).groupBy("student", "term").agg(of(*PASSED).alias("passed"), of("不及格").alias("failed"), of("停修").alias("withdrawn"), of("修課中").alias("ongoing"), F.sum("credits").cast("long").alias("credits"), F.array_join(names, "|").alias("names"))


def last_write(slots: DataFrame) -> DataFrame:
    """One course per slot: the one written last."""
    return slots.groupBy("owner", "day", "period").agg(F.max_by("course", F.struct("pos", "pos2", "course")).alias("course"))


def free_slots(slots: DataFrame) -> DataFrame:
    """Free periods of each owner and day: the grid of 7 days and 13 periods less the occupied slots."""
    taken = slots.groupBy("owner", "day").agg(F.collect_set("period").alias("taken"))
    days = slots.select("owner").distinct().withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(DAYS))))
    free = F.array_except(F.sequence(F.lit(1), F.lit(PERIODS)), F.coalesce("taken", F.array().cast("array<int>")))
    return days.join(taken, ["owner", "day"], "left").select("owner", "day", F.array_join(F.array_sort(free).cast("array<string>"), ",").alias("free"), F.size(free).cast("long").alias("n_free"))


def day_schedule(slots: DataFrame, periods: DataFrame) -> DataFrame:
    """A course's periods of a day as one range, gaps included, with clock times; periods: period, starts, ends."""
    ranges = last_write(slots).groupBy("owner", "day", "course").agg(F.min("period").alias("first"), F.max("period").alias("last"))
    starts = F.broadcast(periods.select(F.col("period").alias("first"), "starts"))
    ends = F.broadcast(periods.select(F.col("period").alias("last"), "ends"))
    return ranges.join(starts, "first").join(ends, "last").select("owner", "day", "course", "first", "last", "starts", "ends")


def enrich(records: DataFrame, catalogue: DataFrame) -> DataFrame:
    """records (id, name, teacher) with the best catalogue row (name, teacher, credits, type): equal names, else a name that holds
    the other or shares the part before a bracket (both at least three characters); the teacher breaks ties.

    Exact names join on equality.  The distinct names that are left meet the catalogue's by their rarest pieces, or by equal parts before a bracket.
    What is best depends on name and teacher only, so it is chosen once for each pair of them and then joined to the records.
    """
    base = lambda c: F.trim(F.regexp_replace(c, "[（(].*$", ""))
    c = sinks.kept(catalogue.select(F.col("name").alias("c_name"), F.col("teacher").alias("c_teacher"), "credits", "type").distinct(), "catalogue")
    asked = sinks.kept(records.where("name IS NOT NULL").select("name", "teacher").distinct(), "asked")
    exact = asked.join(c, F.col("name") == F.col("c_name")).withColumn("tier", F.lit(1))
    rest = asked.join(c.select("c_name").distinct(), F.col("name") == F.col("c_name"), "left_anti")
    names, known = rest.where(F.length("name") >= 3).select("name").distinct(), c.where(F.length("c_name") >= 3).select("c_name").distinct()
    by_base = names.withColumn("base", base("name")).where(F.length("base") >= 3).join(known.withColumn("base", base("c_name")), "base").select("name", "c_name")
    pairs = sinks.kept(either_way(names, known, "name", "c_name").union(by_base).distinct(), "pairs")
    fuzzy = rest.join(pairs, "name").join(c, "c_name").withColumn("tier", F.lit(2))
    teacher = F.col("teacher").contains(F.col("c_teacher")) | F.col("c_teacher").contains(F.col("teacher"))
    w = Window.partitionBy("name", "teacher").orderBy("tier", teacher.desc(), "c_name", "c_teacher", "credits", "type")
    best = exact.unionByName(fuzzy.select(exact.columns)).withColumn("n", F.row_number().over(w)).where("n = 1")
    found = best.select(F.col("name").alias("__name"), F.col("teacher").alias("__teacher"), "tier", "c_name", F.when(F.col("credits") > 0, F.col("credits")).alias("credits"), F.nullif("type", F.lit("")).alias("type"))
    return records.join(found, (F.col("name") == F.col("__name")) & F.col("teacher").eqNullSafe(F.col("__teacher")), "left").drop("__name", "__teacher")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status (new, modified, deleted, unchanged) of two manifests (path, digest)."""
    joined = old.select("path", F.col("digest").alias("old")).join(new.select("path", F.col("digest").alias("new")), "path", "full_outer")
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return joined.select("path", status.alias("status"))


def cache_key(task: str, size: int, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{task}:{size}:"), text), 256)


def cache_split(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """texts (key) with ``hit``: the cache holds the key."""
    return texts.join(cache.select("key", F.lit(True).alias("hit")).distinct(), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def merge_profiles(old: DataFrame, new: DataFrame, key: str, overwrite: list[str], keep: list[str]) -> DataFrame:
    """Upsert: overwritten columns from new rows, kept ones (records, groups) from old rows."""
    n = new.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in overwrite + keep], F.lit(True).alias("__new"))
    joined = old.join(n, old[key] == n["__key"], "full_outer")
    columns = [F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in overwrite]
    return joined.select(F.coalesce(F.col(key), F.col("__key")).alias(key), *columns, *[F.coalesce(c, f"__{c}").alias(c) for c in keep])


def invite_code(name: Column) -> Column:
    """Six upper-case characters, the same for a name at every run."""
    return F.upper(F.left(F.sha2(name, 256), F.lit(6)))


def join_group(groups: Column, name: str) -> Column:
    return F.array_union(groups, F.array(F.lit(name)))


def leave_group(groups: Column, name: str) -> Column:
    return F.array_remove(groups, F.lit(name))


def recommend(candidates: DataFrame, busy: DataFrame, passed: DataFrame) -> DataFrame:
    """candidates (student, course, day, period, score), less passed courses, ranked: without a clash first, then by score."""
    open_ = candidates.join(passed, ["student", "course"], "left_anti")
    clash = open_.join(busy.select("student", "day", "period", F.lit(1).alias("__busy")).distinct(), ["student", "day", "period"], "left")
    rows = clash.groupBy("student", "course").agg(F.max(F.coalesce("__busy", F.lit(0))).alias("clash"), F.max("score").alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("student").orderBy("clash", F.desc("score"), "course")))


#: Codes that a new group may get, in this order.
CODES = 8


def create_groups(wanted: DataFrame, groups: DataFrame) -> DataFrame:
    """name, invite_code, created of each wanted name; groups (name, invite_code): an existing group keeps its code.

    A new one gets the first of ``CODES`` codes of its name that no group has and no other new name comes before it for; null if all are taken.
    """
    names = wanted.select("name").distinct()
    old = names.join(groups.select("name", "invite_code"), "name").select("name", "invite_code", F.lit(False).alias("created"))
    new = names.join(groups.select("name"), "name", "left_anti")
    salted = F.array(*[invite_code(F.concat("name", F.lit(f":{k}" if k else ""))) for k in range(CODES)])
    offers = new.select("name", F.posexplode(salted).alias("k", "invite_code")).join(groups.select("invite_code"), "invite_code", "left_anti")
    claimed = offers.groupBy("invite_code").agg(F.min(F.struct("k", "name")).alias("c")).groupBy("c.name").agg(F.min(F.struct("c.k", "invite_code")).alias("first"))
    made = new.join(claimed, "name", "left").select("name", F.col("first.invite_code").alias("invite_code"), F.lit(True).alias("created"))
    return old.unionByName(made)


def find_group(groups: DataFrame, code: str) -> DataFrame:
    """The group with an invite code, in whichever case it is typed."""
    return groups.where(F.upper("invite_code") == code.strip().upper())


def group_info(groups: DataFrame, name: str) -> DataFrame:
    return groups.where(F.col("name") == name)


def delete_group(groups: DataFrame, users: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """groups and users (with their array of groups) without one group."""
    return groups.where(F.col("name") != name), users.withColumn("groups", leave_group(F.col("groups"), name))


#: Kinds of picture that may be uploaded, and their largest size.
UPLOAD_KINDS = ("image/png", "image/jpeg", "image/jpg", "image/webp")
UPLOAD_BYTES = 10 * 1024 * 1024


def accepted_upload(kind: Column, size: Column, kinds: tuple[str, ...] = UPLOAD_KINDS) -> Column:
    return kind.isin(*kinds) & (size <= UPLOAD_BYTES)


#: Domains of general education, and words of a course or its stated domain that tell them, in the order in which they are asked.
GE_WORDS = {"人文藝術": ("人文", "藝術", "文學", "美學", "哲學", "歷史"), "社會科學": ("社會", "法政", "管理", "經濟", "公民"), "自然科學": ("自然", "科技", "生命", "科學", "資訊", "數學", "環境")}
GE_DEFAULT = "人文藝術"


def ge_domain(courses: DataFrame, known: DataFrame) -> DataFrame:
    """courses (id, name, domain) with ``resolved`` and ``tier``: the domain of the known course (name, domain) of the same name, of the name before its brackets,
    of one that holds the name or is held by it (the first by name), else what words tell, else the default."""
    c = courses.withColumn("__name", F.replace("name", F.lit(" "), F.lit(""))).withColumn("__bare", F.regexp_replace("__name", "[（(].*$", ""))
    k = known.where("name <> ''").groupBy(F.col("name").alias("__key")).agg(F.max("domain").alias("__domain"))
    exact = c.join(k, F.col("__name") == F.col("__key"), "left").withColumnRenamed("__domain", "__exact").drop("__key")
    bare = exact.join(k, F.col("__bare") == F.col("__key"), "left").withColumnRenamed("__domain", "__plain").drop("__key")
    names, keys = bare.where("__exact IS NULL AND __plain IS NULL AND __name <> ''").select("__name").distinct(), k.select("__key")
    near = either_way(names, keys, "__name", "__key").groupBy("__name").agg(F.min("__key").alias("__key"))
    fuzzy = bare.join(near.join(k, "__key").select("__name", F.col("__domain").alias("__fuzzy")), "__name", "left")
    said = F.concat(F.coalesce("domain", F.lit("")), F.lit(" "), F.col("name"))
    told = F.coalesce(*[F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: said.contains(w)), domain) for domain, words in GE_WORDS.items()])
    tiers = [("exact", F.col("__exact")), ("bare", F.col("__plain")), ("fuzzy", F.col("__fuzzy")), ("words", told)]
    tier = F.coalesce(*[F.when(value.isNotNull(), name) for name, value in tiers], F.lit("default"))
    return fuzzy.select(*courses.columns, F.coalesce(*[value for _, value in tiers], F.lit(GE_DEFAULT)).alias("resolved"), tier.alias("tier"))


def timetable_preview(slots: DataFrame) -> DataFrame:
    """owner, day, line: the courses of a day with their periods, as text."""
    from ..functions import lexicon

    day = F.get(F.array(*[F.lit(f"星期{c}") for c in lexicon.WEEKDAYS]), F.col("day") - 1)
    entries = F.array_sort(F.collect_list(F.struct("period", "course")))
    line = F.array_join(F.transform(entries, lambda x: F.concat(F.lit("第"), x["period"].cast("string"), F.lit("節 "), x["course"])), "、")
    return last_write(slots).groupBy("owner", "day").agg(line.alias("line")).select("owner", "day", F.concat(day, F.lit("："), "line").alias("line"))  # a day has PERIODS slots at most
