"""Dashboard and workforce metrics over task, segment, job and user tables.

Columns are named by parameters; sums stay integers or decimals until the end,
where they are rounded once, half up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses that count as having reached a stage.
COLLECTED, ANNOTATED, CHECKED, CONVERTED = (2, 3, 4, 5), (3, 4, 5), (4, 5), (5,)


def seconds(total_ns: Column) -> Column:
    """Nanoseconds as decimal seconds, rounded to hundredths."""
    return F.round(total_ns.cast("decimal(28,0)") * F.lit("0.000000001").cast("decimal(9,9)"), 2)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole in hundredths, half up; null for nothing."""
    return F.round(part.cast("decimal(20,0)") / F.nullif(whole, F.lit(0)).cast("decimal(20,0)"), 2)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as an integer, half up; null for nothing."""
    doubled = 200 * part + whole
    return F.round((doubled - F.pmod(doubled, 2 * whole)) / F.nullif(2 * whole, F.lit(0))).cast("long")


def status_counts(tasks: DataFrame, status: str, names: dict) -> DataFrame:
    """One row: total, and the number of rows of each status, by name."""
    return tasks.agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == value).alias(name) for name, value in names.items()))


def of_status(tasks: DataFrame, status: str, wanted: tuple, number: str | None = None) -> DataFrame:
    """Tasks of some statuses; with a number that is not blank, if asked."""
    kept = tasks.where(F.col(status).isin(*wanted))
    return kept if number is None else kept.where(F.trim(F.coalesce(F.col(number), F.lit(""))) != "")


def level_counts(rows: DataFrame, level: str, always: list) -> DataFrame:
    """(level, n) of the levels of always, with 0 where there is none."""
    counts = rows.where(F.col(level).isin(*always)).groupBy(level).agg(F.count("*").alias("n"))
    wanted = rows.sparkSession.createDataFrame([(v,) for v in always], f"`{level}` {rows.schema[level].dataType.simpleString()}")
    return wanted.join(counts, level, "left").select(level, F.coalesce("n", F.lit(0)).alias("n"))


def conflicts(rows: DataFrame, key: list[str], definition: list[str]) -> DataFrame:
    """key with definitions: their number, where there are several; a null counts as a value."""
    return rows.groupBy(*key).agg(F.count_distinct(F.struct(*definition)).alias("definitions")).where("definitions > 1")


def furthest_then_sum(rows: DataFrame, task: str, part: str, value: str) -> DataFrame:
    """Per task: the sum of its parts' largest values, and the number of parts."""
    return rows.groupBy(task, part).agg(F.max(value).alias("_m")).groupBy(task).agg(F.sum("_m").alias("total"), F.count("*").alias("parts"))


def durations(spans: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """key with seconds: the sum of spans, exact until it is rounded."""
    return spans.groupBy(*key).agg(F.sum(F.col(end) - F.col(start)).alias("_d")).select(*key, seconds(F.col("_d")).alias("seconds"))


def counted(rows: DataFrame, allowed: DataFrame, on: list[str], key: str) -> DataFrame:
    """Rows by key, of those whose `on` is in allowed."""
    return rows.join(allowed.select(*on).distinct(), on, "left_semi").groupBy(key).agg(F.count("*").alias("episodes"))


def latest(rows: DataFrame, key: list[str], when: str, tie: str) -> DataFrame:
    """The newest row of each key: a null time counts as newest, ties go to the larger tie."""
    order = Window.partitionBy(*key).orderBy(F.col(when).desc_nulls_first(), F.col(tie).desc())
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def latest_job_sums(jobs: DataFrame, outputs: DataFrame, task: str, job: str, created: str, output_job: str, episode: str, value: str) -> DataFrame:
    """Per task: episodes of its newest job, and the sum of each episode's largest value."""
    newest = latest(jobs, [task], created, job).select(task, F.col(job).alias("_job"))
    each = newest.join(outputs, F.col("_job") == F.col(output_job)).groupBy(task, episode).agg(F.max(value).alias("_m"))
    return each.groupBy(task).agg(F.count("*").alias("episodes"), F.sum("_m").alias("total"))


def per_creator(users: DataFrame, jobs: DataFrame, outputs: DataFrame, user: str, creator: str, job: str, output_job: str, value: str) -> DataFrame:
    """Per user: jobs, episodes and their total; zeros for users without any."""
    sums = outputs.groupBy(F.col(output_job).alias("_job")).agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    own = jobs.join(sums, F.col(job) == F.col("_job"), "left").groupBy(F.col(creator).alias("_u")).agg(F.count(job).alias("jobs"), F.sum("_n").alias("_n"), F.sum("_v").alias("_v"))
    return users.join(own, F.col(user) == F.col("_u"), "left").select(user, F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("_n", F.lit(0)).alias("episodes"), F.coalesce("_v", F.lit(0)).alias("duration"))


def completion(assignments: list[DataFrame]) -> DataFrame:
    """Per user: tasks and completed ones (done in any of the user's roles).  Each assignment: user_id, task, done; users and tasks without an id go."""
    every = assignments[0]
    for a in assignments[1:]:
        every = every.unionByName(a)
    once = every.where("user_id is not null and task is not null").groupBy("user_id", "task").agg(F.bool_or("done").alias("done"))
    return once.groupBy("user_id").agg(F.count("*").alias("tasks"), F.count_if("done").alias("completed"))


def headcount(people: DataFrame, roles: str, names: list[str], admin: str = "admin") -> DataFrame:
    """One row: people, and those who bear each role once or more; an admin counts for all."""
    held = F.array_distinct(F.coalesce(F.col(roles), F.array().cast("array<string>")))
    has = lambda name: F.array_contains(held, name) | F.array_contains(held, admin)
    return people.agg(F.count("*").alias("people"), *(F.count_if(has(n)).alias(n) for n in names))


def per_person(rows: DataFrame, key: str, person: str) -> DataFrame:
    """Per key: rows, people, and rows a person in hundredths (an integer, half up)."""
    counts = rows.groupBy(key).agg(F.count("*").alias("total"), F.count_distinct(person).alias("people"))
    return counts.withColumn("hundredths", percent(F.col("total"), F.col("people")))


def per_largest_role(counts: DataFrame, total: str, roles: list[str]) -> DataFrame:
    """counts with average: total by the largest role count, in hundredths; null without people."""
    most = F.greatest(*roles) if len(roles) > 1 else F.col(roles[0])
    return counts.withColumn("average", ratio(F.col(total), most))


def total_gap(rows: DataFrame, value: str, baseline: DataFrame, base: str) -> DataFrame:
    """One row: the sum of a column, a baseline's only value, and their difference."""
    both = rows.agg(F.sum(value).alias("total")).withColumn("_k", F.lit(1)).join(baseline.agg(F.max(base).alias("baseline")).withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.withColumn("gap", F.col("total") - F.col("baseline"))


def sizes(files: DataFrame, size: str) -> DataFrame:
    """One row: files and bytes."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
