"""Sources: text records, JSON rules and users, calendar files, web pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, loose
from . import outline

UNKNOWN = "未知"
#: Label of a course record to its column.
COURSE_LABELS = {
    "課程名稱": "course_name", "部別": "department", "開課班級": "grade_class", "學分數": "credits", "授課時數": "hours", "授課教師": "teacher",
    "必選修": "required_or_elective", "教室": "classroom", "上課時間": "schedule", "修課上限人數": "max_students", "學年度": "academic_year", "學期": "semester",
}
#: Section key, label, and labels that may end it, in the order in which they are tried.
COURSE_SECTIONS = [
    ("objectives", "課程教學目標", ["課程教學綱要", "教科書資料"]), ("syllabus", "課程教學綱要", ["教科書資料", "參考書資料"]), ("textbooks", "教科書資料", ["參考書資料", "教學進度表"]),
    ("references", "參考書資料", ["教學進度表", "成績評定方式"]), ("schedule_table", "教學進度表", ["成績評定方式", "課堂要求"]), ("grading", "成績評定方式", ["課堂要求"]), ("requirements", "課堂要求", []),
]


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of each .txt file below a folder."""
    whole = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    return whole.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def section(text: Column, start: str, ends: list[str]) -> Column:
    """The text between a label and an end label: the first of the list that follows, wherever the others are; else to the end."""
    out = F.nullif(F.regexp_extract(text, rf"{start}[:：]?([\s\S]*)", 1), F.lit(""))
    for end in reversed(ends):
        pattern = rf"{start}[:：]?([\s\S]*?){end}"
        out = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(out)
    return F.btrim(F.coalesce(out, F.lit("")), F.lit(" \t\r\n"))


def course_records(files: DataFrame) -> DataFrame:
    """One row per file: labelled fields (未知 if missing), derived fields, and its sections as a map."""
    field = lambda label: F.trim(F.regexp_extract("text", rf"(?m)^{label}[:：][ \t]*(.*)$", 1))
    rows = files.select("path", "text", *[F.coalesce(F.nullif(field(k), F.lit("")), F.lit("0" if c in ("academic_year", "semester") else UNKNOWN)).alias(c) for k, c in COURSE_LABELS.items()], F.coalesce(F.nullif(field("備註"), F.lit("")), field("通識主題領域")).alias("note"))
    general = F.col("path").contains("通識")
    grade = F.when(general, "通識").otherwise(F.regexp_extract("grade_class", "碩[一二三]|博[一二三]|[一二三四五]", 0))
    domain = F.when(F.col("note").contains("人文"), "人文").when(F.col("note").contains("社會"), "社會").when(F.col("note").contains("自然"), "自然").otherwise("")
    sections = F.map_from_arrays(F.array(*[F.lit(k) for k, _, _ in COURSE_SECTIONS]), F.array(*[section(F.col("text"), s, e) for _, s, e in COURSE_SECTIONS]))
    return rows.select("*", grade.alias("grade"), F.regexp_extract("grade_class", "[一二三四五]([甲乙丙丁])", 1).alias("class_group"), domain.alias("ge_domain"), F.col("department").contains("進修").alias("is_evening"), sections.alias("sections"))


def record_pieces(files: DataFrame, least: int = 20, numbered: bool = False) -> DataFrame:
    """path, n, piece: a file cut at --- lines and before 【 headings; shorter pieces are dropped.

    numbered: a file without 【 headings is cut before numbered ones (一、) instead.
    """
    ruled = F.split("text", r"\n---+\n")
    pieces = F.flatten(F.transform(ruled, lambda x: F.split(x, "\n(?=【)")))
    if numbered:
        pieces = F.when(F.col("text").rlike("【.+?】"), pieces).otherwise(F.flatten(F.transform(ruled, lambda x: F.split(x, "\n(?=[一二三四五六七八九十]+、)"))))
    rows = files.select("path", F.posexplode(pieces).alias("n", "piece")).withColumn("piece", F.trim("piece"))
    return rows.where(F.length("piece") >= least)


def contact(piece: Column) -> list[Column]:
    """name, email and phone of a professor's record, 未提供 if missing."""
    given = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("未提供"))
    return [
        given(F.trim(F.regexp_extract(piece, "姓名[:：]([^\n]*)", 1))).alias("name"),
        given(F.regexp_extract(piece, r"([\w.+-]+@[\w-]+\.[\w.]+)", 1)).alias("email"),
        given(F.regexp_extract(piece, r"電話[:：]\s*([\d()#\- ]+\d)", 1)).alias("phone"),
    ]


def folder_kind(path: Column) -> Column:
    """What a data folder holds, by the first rule that fits its name."""
    return F.when(path.rlike("(?i)backup|備份"), "skip").when(path.contains("professor") | path.contains("教授"), "professor").when(path.contains("dept") | path.contains("系所"), "dept_info").when(path.rlike(r"\d{3}[-_]?[12]|course|課程"), "course").otherwise("unknown")


def latest_term(paths: DataFrame) -> DataFrame:
    """Latest (year, semester) named by folder names, without backups."""
    kept = paths.where(folder_kind(F.col("path")) != "skip")
    named = kept.select(F.regexp_extract("path", r"(\d{3})[-_]([12])", 1).alias("year"), F.regexp_extract("path", r"(\d{3})[-_]([12])", 2).alias("semester")).where("year <> ''")
    return named.agg(F.max(F.struct("year", "semester")).alias("t")).select("t.year", "t.semester")


def default_term(ref: Column) -> Column:
    """Term of a day by its month, in years since 1911: August to January is the first semester."""
    month, year = F.month(ref), F.year(ref) - 1911
    return F.when(month >= 8, F.concat(year.cast("string"), F.lit("-1"))).when(month == 1, F.concat((year - 1).cast("string"), F.lit("-1"))).otherwise(F.concat((year - 1).cast("string"), F.lit("-2")))


def rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, category, required_credits, course: JSON rules flattened; a course is an object or a bare name."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    categories = raw.select("path", F.explode(F.from_json(F.to_json(F.try_variant_get("v", "$.categories", "variant")), "map<string,string>")).alias("category", "body"))
    body = categories.select("path", "category", F.try_parse_json("body").alias("b"))
    listed = F.coalesce(F.try_variant_get("b", "$.courses", "array<variant>"), F.array(F.parse_json(F.lit("null"))))
    rows = body.select("path", "category", F.try_variant_get("b", "$.required_credits", "int").alias("required_credits"), F.explode(listed).alias("c"))
    name = F.coalesce(F.try_variant_get("c", "$.name", "string"), F.try_variant_get("c", "$", "string"))
    credits = F.try_variant_get("c", "$.credits", "int")
    return rows.select("path", "category", "required_credits", F.when(credits.isNotNull(), F.concat(name, F.lit("（"), credits.cast("string"), F.lit("學分）"))).otherwise(name).alias("course"))


def course_text(course: Column) -> Column:
    """A course of the rules as text, from its JSON: an object with name, credits, hours, year, semester, note, or a bare name."""
    get = lambda key: F.get_json_object(course, f"$.{key}")
    with_ = lambda key, before, behind: F.coalesce(F.concat(F.lit(before), get(key), F.lit(behind)), F.lit(""))
    when = F.concat_ws(", ", F.concat(F.lit("大"), get("year")), F.concat(F.lit("第"), get("semester"), F.lit("學期")))
    text = F.concat(F.coalesce(get("name"), F.lit("未命名課程")), F.lit(" ("), F.coalesce(get("credits"), F.lit("?")), F.lit("學分"), with_("hours", " (", "小時)"), F.lit(")"), F.when(when != "", F.concat(F.lit(" ["), when, F.lit("]"))).otherwise(""), with_("note", " (備註: ", ")"))
    return F.when(course.startswith("{"), text).otherwise(course)


_CATEGORY = "required_credits int, note string, domains map<string,struct<min_credits:int>>, max_from_other_dept int, courses array<string>, tracks map<string,struct<courses:array<string>>>"


def rule_texts(files: DataFrame) -> DataFrame:
    """files (path, json) to path, info_type, category, department and the text of all the rules; files that are no JSON object give no row."""
    schema = "_description string, department string, total_required int, categories map<string,string>, graduation_conditions array<string>"
    rules = files.select("path", F.from_json("json", schema).alias("r"), F.get_json_object("json", "$").alias("whole")).where(F.col("whole").startswith("{"))
    desc, dept = F.coalesce("r._description", F.lit("系統規章")), F.coalesce("r.department", F.lit("全校"))
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    number = lambda c: F.coalesce(c, F.lit(0))
    none = F.array().cast("array<string>")

    def category(entry: Column) -> Column:
        name, c = entry["key"], F.from_json(entry["value"], _CATEGORY)
        head = F.concat(said("## ", name, " (", number(c["required_credits"]), " 學分)"), F.when(F.coalesce(c["note"], F.lit("")) != "", said(" - ", c["note"])).otherwise(""))
        domains = F.transform(F.map_entries(c["domains"]), lambda d: said("- ", d["key"], "領域：至少 ", number(d["value"]["min_credits"]), " 學分"))
        other = F.when(c["max_from_other_dept"].isNotNull(), F.array(said("- 【注意】可承認外系(所)學分上限：", c["max_from_other_dept"], " 學分")))
        courses = F.transform(c["courses"], lambda x: said("- ", course_text(x)))
        tracks = F.flatten(F.transform(F.map_entries(c["tracks"]), lambda t: F.when(F.size(t["value"]["courses"]) > 0, F.array(said("### ", t["key"]), said("- 包含課程：", F.array_join(F.transform(t["value"]["courses"], course_text), ", "), "\n"))).otherwise(F.array(said("### ", t["key"])))))
        return F.concat(F.array(head), *[F.coalesce(x, none) for x in (domains, other, courses, tracks)])

    head = F.array(said("# ", desc), said("**適用系所**：", dept), said("**畢業學分門檻**：", number(F.col("r.total_required")), " 學分\n"))
    body = F.coalesce(F.flatten(F.transform(F.map_entries("r.categories"), category)), none)
    conditions = F.when(F.size("r.graduation_conditions") > 0, F.concat(F.array(F.lit("## 其他畢業條件")), F.transform("r.graduation_conditions", lambda x: said("- ", x)))).otherwise(none)
    grad = is_graduation_file(F.regexp_extract("path", "[^/]*$", 0))
    text = F.concat(said("[", dept, " ", desc, "]\n"), F.array_join(F.concat(head, body, conditions), "\n"))
    return rules.select("path", F.when(grad, "graduation_rules").otherwise("policy_rules").alias("info_type"), F.when(grad, "畢業門檻與修業規定").otherwise("系統規章").alias("category"), dept.alias("department"), text.alias("text"))


def is_graduation_file(name: Column) -> Column:
    return F.lower(name).contains("graduation") | name.contains("畢業")


def rule_file(short: Column, full: Column, names: list[str]) -> Column:
    """The file, of a folder's names, with a department's graduation rules: one with its name, else any; the first by name."""
    grad = F.filter(F.array(*[F.lit(n) for n in sorted(names)]), is_graduation_file)
    bare = lambda name: F.nullif(F.regexp_replace(name, "學系|[系所]", ""), F.lit(""))
    own = F.filter(grad, lambda n: F.coalesce(F.lower(n).contains(F.lower(bare(short))), F.lit(False)) | F.coalesce(F.lower(n).contains(F.lower(bare(full))), F.lit(False)))
    return F.coalesce(F.get(own, F.lit(0)), F.get(grad, F.lit(0)))


def repaired_json(text: Column) -> Column:
    """A model's JSON object with its faults mended (``functions/loose.py``); a text without one is left as it is."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([loose.mended(x) for x in column.to_pylist()], pa.string())

    return run(text)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON file or folder; none if it is missing."""
    try:
        return spark.read.option("multiLine", True).schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def calendar_file(spark: SparkSession, path: str) -> DataFrame:
    """title, start, end of a JSON array of events; no rows if the file is missing."""
    rows = _json(spark, path, "title string, start string, end string")
    return rows.select("title", F.col("start").try_cast("timestamp_ntz").alias("start"), F.col("end").try_cast("timestamp_ntz").alias("end"))


def user_file(spark: SparkSession, folder: str, telegram_folder: str, user_id: str, schema: str) -> DataFrame:
    """The document of one user, whose platform is in the id; no rows if there is none."""
    if "/" in user_id or user_id.startswith("."):
        raise ValueError("an id names no folder")
    return _json(spark, f"{telegram_folder if user_id.startswith('tg_') else folder}/{user_id}_token.json", schema)


def json_records(texts: DataFrame, schema: str, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """Parsed rows, mended where needed, and quarantined ones; an object under ``transcript`` or ``schedule`` is taken out of its envelope."""
    parsed = texts.withColumn("__v", F.coalesce(F.try_parse_json(column), F.try_parse_json(repaired_json(F.col(column)))))
    inner = F.coalesce(F.try_variant_get("__v", "$.transcript", "variant"), F.try_variant_get("__v", "$.schedule", "variant"), F.col("__v"))
    good = parsed.where("__v IS NOT NULL").select(*texts.columns, F.from_json(F.to_json(inner), schema).alias("record"))
    return good, parsed.where("__v IS NULL").drop("__v")


def user_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """user_id (from the file name), platform and the document of each *_token.json file."""
    rows = spark.read.option("multiLine", True).schema(schema).option("pathGlobFilter", "*_token.json").json(folder)
    user = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_token\.json$", 1)
    return rows.select(user.alias("user_id"), F.when(user.startswith("tg_"), "telegram").otherwise("discord").alias("platform"), F.struct(*rows.columns).alias("document"))


def page_links(pages: DataFrame, least: int = 1) -> DataFrame:
    """page_id, n, url, title: links of a page outside comments, scripts and styles; n counts those with an address."""

    @F.arrow_udf("array<struct<url:string,title:string>>")
    def found(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("url", pa.string()), ("title", pa.string())]))
        return pa.array([outline.links(x) for x in column.to_pylist()], kind)

    rows = pages.select("page_id", F.posexplode(found("html")).alias("n", "a"))
    return rows.select("page_id", "n", "a.url", "a.title").where(F.length("title") >= least)


def matching_news(rows: DataFrame, words: list[str], order: list[str]) -> DataFrame:
    """Rows whose title holds any word, at most 15; the first 10 of all if none does."""
    hit = F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.lower("title").contains(w))
    hits = rows.where(hit).orderBy(*order).limit(15)
    return rows.orderBy(*order).limit(10) if hits.isEmpty() else hits


def path_department(path: Column, division: Column) -> Column:
    """Short name of the department whose longest keyword is in a path; that of its master's programme if the division says so."""
    words = sorted(((w, key) for key, _, _, keywords in lexicon.DEPARTMENTS for w in keywords), key=lambda x: -len(x[0]))
    listed = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(key).alias("key")) for w, key in words])
    found = F.coalesce(F.get(F.filter(listed, lambda x: path.contains(x["word"])), F.lit(0))["key"], F.lit("未知系"))
    masters = F.when(found.contains("系"), F.replace(found, F.lit("系"), F.lit("碩"))).otherwise(F.concat(found, F.lit("碩")))
    return F.when(division.contains("研究所") | division.contains("碩士"), masters).otherwise(found)


def folder_department(name: Column) -> Column:
    """A department's name read off a folder that no keyword fits."""
    named = F.regexp_extract(name, "([^系所]{2,}(?:系|所))", 1)
    bare = F.regexp_replace(name, "(?:教授資訊|系所資訊|簡介|系所)$", "")
    return F.when(named != "", named).when(bare.rlike("(?:系|所|中心)$"), bare).otherwise(F.concat(bare, F.lit("系")))


#: Words of a department file's name, and what it holds, in the order in which they are asked.
DEPARTMENT_FILES = [
    (("簡介",), "dept_intro", "系所簡介"), (("就業",), "career_info", "就業方向"), (("學會",), "student_union", "系學會"), (("新聞", "最新"), "dept_news", "系所新聞"),
    (("師資",), "professor_info", "教授資訊"), (("設備", "教室", "實驗室"), "facility_info", "教學設備與教室"),
]


def department_texts(files: DataFrame) -> DataFrame:
    """files (path, text) of folders of professors and departments to path, n, info_type, category, dept_short, professor_name and text under its header.

    Professors' files are cut at ruled lines (a list of the staff before its 【 headings) and pieces under 20 characters dropped; others
    before 【 or, without any, numbered headings, and pieces under 10 dropped.
    """
    part = lambda k: F.element_at(F.split("path", "/"), k)
    name, folder = part(-1), F.when(F.size(F.split("path", "/")) > 1, part(-2)).otherwise("")
    professors = F.col("path").rlike("(^|/)professors/")
    ladder = [(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: name.contains(w)), kind, label) for words, kind, label in DEPARTMENT_FILES]
    kind = F.coalesce(F.when(professors, "professor_info"), *[F.when(hit, k) for hit, k, _ in ladder], F.lit("dept_general"))
    label = F.coalesce(F.when(professors, "教授資訊"), *[F.when(hit, x) for hit, _, x in ladder], F.lit("系所資訊"))
    named = sorted(((w, key) for key, full, aliases, keywords in lexicon.DEPARTMENTS for w in (key, full, *aliases, *keywords)), key=lambda x: -len(x[0]))
    dept = F.coalesce(*[F.when(folder.contains(w), F.lit(key)) for w, key in named], folder_department(folder))
    heads = F.split("text", "\n(?=【)")
    staff = F.when(name == "師資陣容.txt", heads).otherwise(F.split("text", r"\n-{3,}\n"))
    other = F.when(F.col("text").rlike("【.+?】"), heads).otherwise(F.split("text", "\n(?=[一二三四五六七八九十]+、)"))
    rows = files.select("path", kind.alias("info_type"), label.alias("category"), dept.alias("dept_short"), F.posexplode(F.when(kind == "professor_info", staff).otherwise(other)).alias("n", "piece"))
    piece = F.regexp_replace("piece", r"^\s+|\s+$", "")
    person = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(piece, p, 1)), F.lit("")) for p in (r"姓名[：:]\s*([^（(\n]+?)\s*[（(\n]", "【(.+?)】")], F.lit("未知教授"))
    staffed = F.col("info_type") == "professor_info"
    _, email, phone = contact(piece)
    header = F.when(staffed, F.concat(F.lit("["), "dept_short", F.lit("教授資訊 | 教授："), person, F.lit(" | Email："), email, F.lit(" | 電話："), phone, F.lit("]\n"))).otherwise(F.concat(F.lit("["), "dept_short", "category", F.lit("]\n")))
    kept = rows.where(F.length(piece) >= F.when(staffed, 20).otherwise(10))
    return kept.select("path", "n", "info_type", "category", "dept_short", F.when(staffed, person).alias("professor_name"), F.concat(header, piece).alias("text"))


#: Titles of navigation links.
NAVIGATION = ("關於金大", "行政單位", "學術單位", "招生資訊", "教職員", "學生", "新生專區", "一般訪客", "校長遴選", "網站導覽", "校訊", "English", "首頁", "跳到主要")


def announcements(pages: DataFrame, site: str, most: int = 15) -> DataFrame:
    """page_id, n, title, url, unit, date of a page's announcements, ``most`` a page (``outline.announcements`` says which); addresses within the site are made whole."""

    @F.arrow_udf("array<struct<title:string,url:string,unit:string,date:string>>")
    def found(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(c, pa.string()) for c in ("title", "url", "unit", "date")]))
        return pa.array([outline.announcements(x, NAVIGATION, most) for x in column.to_pylist()], kind)

    rows = pages.select("page_id", F.posexplode(found("html")).alias("n", "a"))
    whole = F.when(F.col("a.url").startswith("http") | (F.col("a.url") == ""), F.col("a.url")).otherwise(F.concat(F.lit(site), F.col("a.url")))
    return rows.select("page_id", "n", "a.title", whole.alias("url"), "a.unit", "a.date")
