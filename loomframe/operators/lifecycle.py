"""Document lifecycle: status logs to latest states, readiness, project states, text checks, question histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomframe.functions import text as T

STAGES = ("ocr", "text", "clean")


def status_partials(events: DataFrame) -> DataFrame:
    """(doc_id, info, <stage>, error) of events: the last (ts, event_id) of each stage, with pdf_info's pdf_kind; mergeable."""
    at = F.struct("ts", "event_id")
    info = F.when(F.col("stage") == "pdf_info", F.struct("ts", "event_id", "pdf_kind"))
    return merged_status(events.select("doc_id", info.alias("info"), *[F.when(F.col("stage") == s, at).alias(s) for s in (*STAGES, "error")]))


def merged_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("info", *STAGES, "error")])


def finished_status(partials: DataFrame) -> DataFrame:
    reset = F.struct("info.ts", "info.event_id")
    kept = lambda c: F.when(F.col("info").isNull() | (F.col(c) >= reset), F.col(c)).alias(c)
    out = partials.select("doc_id", F.col("info.pdf_kind").alias("pdf_kind"), *[kept(c) for c in (*STAGES, "error")])
    good = F.greatest(*[F.col(s) for s in STAGES])
    error = F.when(good.isNull() | (F.col("error") > good), F.col("error.ts"))
    flags = [c for s in STAGES for c in (F.col(s).isNotNull().alias(f"{s}_done"), F.col(f"{s}.ts").alias(f"{s}_at"))]
    return out.select("doc_id", "pdf_kind", *flags, error.alias("error_at"))


def latest_status(events: DataFrame) -> DataFrame:
    """(doc_id, pdf_kind, <stage>_done and <stage>_at, error_at) after all events of stage pdf_info, ocr, text, clean or error.

    pdf_info resets all; a stage sets its flag and time and clears the error; error sets its own time. Equal times: the later
    event_id counts. A document without pdf_info begins with its first event.
    """
    return finished_status(status_partials(events))


def ready(kind: Column, text_done: Column, clean_done: Column, locked: Column | None = None) -> Column:
    """Text documents need their text, images a cleaned text; where a lock is asked for, that too."""
    out = ((kind == "text") & text_done) | ((kind == "image") & clean_done)
    return out & locked if locked is not None else out


def source_choice(kind: Column, has_clean: Column, has_raw: Column, locked: Column | None = None) -> Column:
    """Struct (kind, reason): images take the clean text; texts the clean, else the raw; else none. Where a lock is asked for,
    nothing is taken without it."""
    clean, raw = F.struct(F.lit("clean").alias("kind"), F.lit("").alias("reason")), F.struct(F.lit("raw").alias("kind"), F.lit("").alias("reason"))
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit("no text").alias("reason"))
    out = F.when(has_clean, clean).when((kind == "text") & has_raw, raw).otherwise(none)
    open_ = F.struct(F.lit(None).cast("string").alias("kind"), F.lit("not locked").alias("reason"))
    return out if locked is None else F.when(F.coalesce(locked, F.lit(False)), out).otherwise(open_)


def project_state(projects: DataFrame, rag: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (project_year, project_no) with state and permissions: S0 not registered, S3 locked, S4 taken in, else S1; the lock
    comes before what is taken in."""
    key = ["project_year", "project_no"]
    own = wanted.join(projects.select(*key, "pdf_lock_flag"), key, "left").join(rag.select(*key, F.lower(F.trim("rag_status")).alias("rag")), key, "left")
    lock, taken = F.coalesce("pdf_lock_flag", F.lit(0)) == 1, F.coalesce("rag", F.lit("")) == "ingested"
    state = F.when(F.col("pdf_lock_flag").isNull(), "S0").when(lock, "S3").when(taken, "S4").otherwise("S1")
    return own.select(*key, state.alias("state")).withColumn("can_insert", F.col("state") == "S0").withColumn("can_edit_pdf", F.col("state") != "S3").withColumn("can_edit_text", F.col("state") != "S4")


def text_check(done: Column, level: Column, problems: Column, special: Column, allow_special: Column, manual_ok: Column, skip: Column) -> Column:
    """The first of: skip, unchecked, manual_ok, needs_review, special_ok, needs_review for special pages, ok."""
    bad = level.isin("warning", "error") | (problems > 0)
    return F.when(skip, "skip").when(~done, "unchecked").when(manual_ok, "manual_ok").when(bad, "needs_review").when((special > 0) & allow_special, "special_ok").when(special > 0, "needs_review").otherwise("ok")


def manual_ok_valid(flag: Column, names: list[Column], now: Column, then: Column) -> Column:
    """The flag, while all names agree and both hashes are whole and equal."""
    same = F.lit(True)
    for n in names[1:]:
        same = same & (n == names[0])
    return F.coalesce(flag & same & T.sha256_or_null(now).isNotNull() & (T.sha256_or_null(now) == T.sha256_or_null(then)), F.lit(False))


def reports_of(projects: DataFrame, year: int) -> DataFrame:
    """Projects of a year whose report has a stored name, by number."""
    name = T.blank_to_null(F.col("report_pdf_stored_filename"))
    return projects.filter((F.col("project_year") == year) & name.isNotNull()).orderBy("project_no").select("project_year", "project_no", name.alias("stored"))


def check_decision(locked: Column, done: Column, kind: Column, has_file: Column) -> Column:
    """What a year's check does with a report: skip unless locked or when done, error without a file, else image or text."""
    return F.when(~locked, "skip").when(done, "done").when(~has_file, "error").when(kind == "image", "image").otherwise("text")


def year_totals(checks: DataFrame) -> DataFrame:
    """(project_year, total, processed, text, replaced, image, skipped, error, message) of checked reports: rows with a decision
    of check_decision and whether the report had a text before, which a check replaces."""
    d, again = F.col("decision"), F.coalesce("had_text", F.lit(False))
    count = lambda c, name: F.count_if(c).alias(name)
    parts = [count((d == "text") & ~again, "text"), count((d == "text") & again, "replaced"), count(d == "image", "image"), count(d.isin("skip", "done"), "skipped"), count(d == "error", "error")]
    out = checks.groupBy("project_year").agg(F.count("*").alias("total"), *parts)
    out = out.withColumn("processed", F.col("text") + F.col("replaced") + F.col("image"))
    done = F.format_string("%d of %d: %d new, %d replaced, %d images, %d skipped, %d errors", "processed", "total", "text", "replaced", "image", "skipped", "error")
    return out.withColumn("message", F.when(F.col("skipped") == F.col("total"), "all skipped").otherwise(done))


#: What each action on a report does to the columns of its project; locked projects refuse all but unlock.
REPORT_ACTIONS = ("replace", "lock", "unlock", "delete")


def report_updates(projects: DataFrame, actions: DataFrame) -> DataFrame:
    """projects after actions (project_year, project_no, action, stored), one of each project at most, with outcome: done, refused
    (a locked project's report is neither replaced nor deleted; without a report there is nothing to lock), or null without one."""
    key = ["project_year", "project_no"]
    own = projects.join(actions.select(*key, "action", F.col("stored").alias("__stored")), key, "left")
    locked, there = F.coalesce("pdf_lock_flag", F.lit(0)) == 1, T.blank_to_null(F.col("report_pdf_stored_filename")).isNotNull()
    act = F.col("action")
    unknown = F.raise_error(F.lit("unknown action")).cast("string")
    outcome = F.when(act.isNull(), F.lit(None).cast("string")).when(~act.isin(*REPORT_ACTIONS), unknown)
    outcome = outcome.when(act.isin("replace", "delete") & locked | (act == "lock") & ~there, "refused").otherwise("done")
    own = own.withColumn("outcome", outcome)
    did = lambda *names: (F.col("outcome") == "done") & act.isin(*names)
    flag = F.when(did("lock"), 1).when(did("unlock"), 0).otherwise(F.col("pdf_lock_flag"))
    name = F.when(did("replace"), F.col("__stored")).when(did("delete"), F.lit(None).cast("string")).otherwise(F.col("report_pdf_stored_filename"))
    return own.withColumn("pdf_lock_flag", flag.cast("int")).withColumn("report_pdf_stored_filename", name).drop("__stored")


def run_decision(selected: Column, has_output: Column, forced: Column, failed: Column) -> Column:
    """What a run does with a document: nothing unless selected, skip where outputs are there and it is not forced, else error if
    its source fails, processed where there were outputs, new where there were none."""
    there = F.coalesce(has_output, F.lit(False))
    return F.when(~F.coalesce(selected, F.lit(False)), F.lit(None).cast("string")).when(there & ~F.coalesce(forced, F.lit(False)), "skip").when(F.coalesce(failed, F.lit(False)), "error").when(there, "processed").otherwise("new")


def run_totals(decided: DataFrame, *by: str) -> DataFrame:
    """(ok, new, processed, skip, error) of decided rows; what is not selected does not count."""
    d = F.col("decision")
    count = lambda name: F.count_if(d == name).alias(name)
    return decided.groupBy(*by).agg(F.count_if(d.isin("new", "processed")).alias("ok"), *map(count, ("new", "processed", "skip", "error")))


def answer_payload(question: Column, answer: Column, years: Column, top_k: Column, references: Column) -> Column:
    """JSON of a question, its result and what it refers to; texts trimmed."""
    query = F.struct(F.trim(question).alias("question"), top_k.cast("int").alias("top_k"), years.alias("selected_years"))
    return F.to_json(F.struct(query.alias("query"), F.struct(F.trim(answer).alias("answer")).alias("result"), references.alias("used_references")))


def newest(rows: DataFrame, by: str, order: list[Column], n: int = 5) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def question_record(rows: DataFrame) -> DataFrame:
    """Rows to append to a history: text trimmed, years as JSON."""
    return rows.select("user_sub", F.trim("question").alias("question"), F.trim("answer").alias("answer"), F.to_json("years").alias("selected_years_json"), F.coalesce("hit_count", F.lit(0)).alias("hit_count"))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): a user's turn and the assistant's next."""
    order = W.partitionBy("conv_id").orderBy("turn")
    own = conversations.withColumn("answer", F.lead("text").over(order)).withColumn("next", F.lead("role").over(order))
    return own.filter("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def status_row(catalogue: DataFrame, status: DataFrame) -> DataFrame:
    """Each catalogued document with its typed status; without one, the defaults."""
    own = catalogue.join(status, "doc_id", "left")
    flag = lambda c: F.coalesce(T.to_bool(F.col(c)), F.lit(False)).alias(c)
    kind = F.lower(F.trim("pdf_kind"))
    return own.select("doc_id", F.when(kind.isin("text", "image"), kind).alias("pdf_kind"), T.positive_int(F.col("page_count")).alias("page_count"), flag("text_extracted"), flag("cleaned"), T.blank_to_null(F.col("error_message")).alias("error_message"))


def extraction_record(status: DataFrame) -> DataFrame:
    """(doc_id, record): nested extract and cleaning parts; cleaning is null where it never ran."""
    extract = F.struct(F.col("pdf_kind").alias("kind"), F.col("text_at").alias("at"))
    return status.select("doc_id", F.to_json(F.struct(extract.alias("extract"), F.when(F.col("clean_done"), F.struct(F.col("clean_at").alias("at"))).alias("cleaning"))).alias("record"))


def readiness(catalogue: DataFrame, status: DataFrame, pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, pdf_kind, has_pages, ready, ingested) of each catalogued document; the three others are keyed by doc_id."""
    known = lambda df, name: df.select("doc_id").distinct().withColumn(name, F.lit(True))
    own = catalogue.join(status, "doc_id", "left").join(known(pages, "p"), "doc_id", "left").join(known(manifest, "m"), "doc_id", "left")
    is_ready = ready(F.col("pdf_kind"), F.col("text_done"), F.col("clean_done"))
    no = F.lit(False)
    return own.select("doc_id", "pdf_kind", F.coalesce("p", no).alias("has_pages"), F.coalesce(is_ready, no).alias("ready"), F.coalesce("m", no).alias("ingested"))


def latest_by_flag(events: DataFrame, key: str, flag: str) -> DataFrame:
    """(key, flag, value) after all events (set, clear): the last of each key and flag counts."""
    last = F.max_by("value", F.struct("ts", "event_id"))
    return events.groupBy(key, flag).agg(last.alias("value"))


def selected_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, page_no, pos) in order without repeats; a page that its document does not have is an error."""
    own = wanted.groupBy("doc_id", "page_no").agg(F.min("pos").alias("pos"))
    there = pages.select("doc_id", "page_no", F.lit(1).alias("there"))
    out = own.join(there, ["doc_id", "page_no"], "left")
    return out.select("doc_id", F.when(F.col("there").isNull(), F.raise_error(F.lit("no such page")).cast("long")).otherwise(F.col("page_no")).alias("page_no"), "pos")


def already_processed(kind: Column, text_done: Column, clean_done: Column, has_output: Column) -> Column:
    """Images once cleaned; texts once extracted and with their output there."""
    return F.coalesce(((kind == "image") & clean_done) | ((kind == "text") & text_done & has_output), F.lit(False))


def text_check_results(events: DataFrame, key: str) -> DataFrame:
    """(key, level, pages) of the last check: an unknown level is an error; pages are kept, sorted and once each, unless ok."""
    last = F.max_by(F.struct("level", "pages"), F.struct("ts", "event_id"))
    own = events.groupBy(key).agg(last.alias("l")).select(key, F.lower(F.trim("l.level")).alias("level"), F.col("l.pages").alias("pages"))
    level = F.when(F.col("level").isin("ok", "warning", "error"), F.col("level")).otherwise(F.raise_error(F.lit("unknown level")).cast("string"))
    return own.select(key, level.alias("level"), F.when(F.col("level") != "ok", T.page_numbers(F.col("pages"))).alias("pages"))
