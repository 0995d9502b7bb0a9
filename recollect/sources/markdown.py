"""Markdown as source and sink: sections to items, directories to memories, memories to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

#: Lines that tell the state of a machine, not anything to remember. The words of this list and of the others like it
#: (conflicts, stale content, hints of intent) are behaviour that users know, not free to choose.
NOISE = (
    "(?i)heartbeat_ok", "session_status", r"cron 会话[^\n\r]*\d+k", "轻量复查", "距上次心跳", r"PR\s*#\d+\s*(?:状态无变化|无变化)", "基线(?:仍|不变|未变)",
    r"仍为[^\n\r]*critical", "没有新增状态变化", "没有紧急", "危险区协议", "继续安静", "深夜时段", "无紧急", "无变化", r"无新[^\n\r]{0,4}(?:进展|事项|变化|delta)", "不打扰", "安静待命", "安静模式",
)


def noise(line: Column, product: str = "") -> Column:
    """product: the name of the assistant whose own status lines are noise too, if any."""
    out = F.lit(False)
    for pattern in (*NOISE, *([rf"(?i){product} (?:update status|security audit|gateway status|status)"] if product else [])):
        out = out | text.matches(line, pattern)
    return out


def kind_of(title: Column) -> Column:
    low = F.lower(title)
    has = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in words])
    return F.when(has("emotion", "情感"), "emotion").when(has("event", "journal", "事件"), "event").when(has("identity", "about", "身份"), "identity").otherwise("knowledge")


def bullets(files: DataFrame) -> DataFrame:
    """(file, title, type, block, line, content): the lines of each section with a body, bullets stripped."""
    sections = files.select("file", F.posexplode(F.split("text", r"(?m)^##\s+")).alias("block", "section")).filter(text.stripped(F.col("section")) != "")
    title = F.coalesce(F.nullif(text.stripped(F.split("section", "\n")[0]), F.lit("")), F.lit("knowledge"))
    body = F.array_join(F.slice(F.split("section", "\n"), F.lit(2), F.size(F.split("section", "\n"))), "\n")
    parts = F.filter(F.transform(F.split(body, r"\n+"), lambda x: text.stripped(F.regexp_replace(x, r"^[-*]\s*", ""))), lambda x: x != "")
    lines = sections.select("file", "block", title.alias("title"), F.posexplode(parts).alias("line", "content"))
    return lines.select("file", "title", kind_of(F.col("title")).alias("type"), "block", "line", "content")


def items(files: DataFrame, source: Column | None = None) -> DataFrame:
    """(file, index, type, content, uri) of files (file, text); index counts what isn't noise, per file from 1."""
    kept = bullets(files).filter(~noise(F.col("content")))
    index = F.row_number().over(Window.partitionBy("file").orderBy("block", "line")).cast("long")
    slug = text.slugify(source if source is not None else F.lit("ingest"))
    uri = F.when(F.col("type") == "identity", F.concat(F.lit("core://ingest/"), text.slugify(F.col("title")))).otherwise(F.concat("type", F.lit("://"), slug))
    return kept.withColumn("index", index).select("file", "index", "type", "content", F.concat(uri, F.lit("/"), F.col("index").cast("string")).alias("uri"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, folder, text) of markdown files, one row each."""
    rows = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.{md,qmd}").option("recursiveFileLookup", True).load(path)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("folder"), F.col("value").alias("text"))


def import_directory(spark: SparkSession, path: str) -> DataFrame:
    """(content, type, uri, source): sections of MEMORY.md, daily journals, and weekly notes of a directory."""
    files = read_files(spark, path)
    slug = lambda c: F.lower(F.regexp_replace(c, rf"[^a-zA-Z0-9{text.HAN}]", "-"))
    bare = F.regexp_replace("file", r"\.q?md$", "")
    main = files.filter(F.col("file").isin("MEMORY.md", "MEMORY.qmd") & (F.col("folder") != "weekly"))
    main = main.withColumn("_n", F.row_number().over(Window.partitionBy("folder").orderBy("file"))).filter("_n = 1")  # .md before .qmd
    parts = main.select("file", F.explode(F.split("text", "(?m)^## ")).alias("section")).filter(text.stripped(F.col("section")) != "")
    title, body = text.stripped(F.split("section", "\n")[0]), text.stripped(F.array_join(F.slice(F.split("section", "\n"), F.lit(2), F.size(F.split("section", "\n"))), "\n"))
    about = F.contains(F.lower(title), F.lit("about")) | F.contains(title, F.lit("关于"))
    sections_ = parts.filter(body != "").select(F.concat(F.lit("## "), title, F.lit("\n"), body).alias("content"), F.when(about, "identity").otherwise("knowledge").alias("type"), F.concat(F.lit("knowledge://memory-md/"), slug(title)).alias("uri"), F.concat(F.lit("migrate:"), F.col("file")).alias("source"))
    daily = files.filter(F.col("file").rlike(r"^\d{4}-\d{2}-\d{2}\.q?md$") & (F.col("folder") != "weekly")).select(F.col("text").alias("content"), F.lit("event").alias("type"), F.concat(F.lit("event://journal/"), bare).alias("uri"), F.concat(F.lit("migrate:"), F.col("file")).alias("source"))
    weekly = files.filter(F.col("folder") == "weekly").select(F.col("text").alias("content"), F.lit("knowledge").alias("type"), F.concat(F.lit("knowledge://weekly/"), bare).alias("uri"), F.concat(F.lit("migrate:weekly/"), F.col("file")).alias("source"))
    return sections_.unionByName(daily).unionByName(weekly)


def journals(memories: DataFrame, agent: str, most: int = 10_000) -> DataFrame:
    """(file, n, body): a markdown file for each day of an agent's events."""
    rows = memories.filter((F.col("agent_id") == agent) & (F.col("type") == "event")).orderBy("priority", F.desc("updated_at"), "id").limit(most)
    line = F.struct("priority", (-F.unix_micros("updated_at")).alias("u"), "id", F.concat(F.lit("- "), "content", F.lit("\n")).alias("line"))
    days = rows.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(line)).alias("l"))
    return days.select(F.concat("day", F.lit(".md")).alias("file"), "n", F.concat(F.lit("# "), "day", F.lit("\n\n"), F.array_join("l.line", "\n")).alias("body"))


def sections(memories: DataFrame, agent: str, most: int = 100) -> DataFrame:
    """(type, n, body): the first rows of an agent's lasting memories, as the lists of its memory file."""
    order = Window.partitionBy("type").orderBy("priority", F.desc("updated_at"), "id")
    rows = memories.filter((F.col("agent_id") == agent) & F.col("type").isin("identity", "emotion", "knowledge")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    line = F.struct("r", F.concat(F.lit("- "), "content").alias("line"))
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(line))["line"], "\n").alias("body"))


def recent(surfaced: DataFrame, memories: DataFrame, since: str, now: str, limit: int = 50) -> DataFrame:
    """(type, line_no, line) of surfaced (id, rank) memories updated since: a list line each, by type, in order of rank."""
    from ..functions import scores

    rows = surfaced.select("id", "rank").join(memories.select("id", "type", "content", "updated_at", "emotion_tag"), "id").filter(F.col("updated_at") >= scores.instant(since)).orderBy("rank").limit(limit)
    when = scores.relative_date(F.col("updated_at"), now)
    meta = F.when((F.col("type") == "emotion") & (F.col("emotion_tag") != ""), F.concat(F.lit("("), "emotion_tag", F.lit(", "), when, F.lit(")"))).otherwise(F.concat(F.lit("("), when, F.lit(")")))
    number = F.row_number().over(Window.partitionBy("type").orderBy("rank")).cast("long")
    return rows.select("type", number.alias("line_no"), F.concat(F.lit("- "), text.first_line(F.col("content")), F.lit(" "), meta).alias("line"))


def recent_file(lines: DataFrame, now: str) -> str:
    """The document of those lines, at most as many as were asked for."""
    titles, found = {"identity": "Identity", "emotion": "Emotion", "knowledge": "Knowledge", "event": "Events"}, lines.orderBy("type", "line_no").collect()
    parts = ["# Recent Memories\n", f"> Last updated: {now}\n"]
    for kind, title in titles.items():
        own = [r["line"] for r in found if r["type"] == kind]
        parts += [f"## {title}", *own, ""] if own else []
    return "\n".join(parts)


def export(memories: DataFrame, agent: str, folder: str) -> list[str]:
    """Writes the memory file and the journals of an agent to a local folder; the files' names.

    Files are written one by one as they come; no more than one is held.
    """
    from pathlib import Path

    out, names = Path(folder), []
    out.mkdir(parents=True, exist_ok=True)
    parts = {r["type"]: r["body"] for r in sections(memories, agent).toLocalIterator()}
    if parts:
        titles = {"identity": "Identity", "emotion": "Emotions", "knowledge": "Knowledge"}
        body = ["# Memories\n", *[f"## {title}\n\n{parts[kind]}\n" for kind, title in titles.items() if kind in parts]]
        (out / "MEMORY.md").write_text("\n".join(body), encoding="utf-8")
        names.append("MEMORY.md")
    for row in journals(memories, agent).toLocalIterator():
        (out / row["file"]).write_text(row["body"], encoding="utf-8")
        names.append(row["file"])
    return names
