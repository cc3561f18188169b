"""Transcripts: payloads to utterances, identifiers, quality, and the roles of speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairn.functions import text as T, times

SPEAKER_NAMES, TEXT_NAMES = ("speaker", "name"), ("text", "content")


def normalise_calls(raw: DataFrame, ordinal: str) -> DataFrame:
    """raw (ticker, call_datetime, year?, quarter?, ordinal): upper ticker, year and quarter of the call where missing, and
    call_id TICKER_YYYYQn, repeated ones with _2, _3 in the order of ordinal."""
    when = F.col("call_datetime")
    year = F.coalesce(F.col("year"), F.year(when)) if "year" in raw.columns else F.year(when)
    quarter = F.coalesce(F.col("quarter"), F.quarter(when)) if "quarter" in raw.columns else F.quarter(when)
    out = raw.withColumn("ticker", F.upper(F.trim("ticker"))).withColumn("year", year).withColumn("quarter", quarter)
    out = out.withColumn("has_time", when.isNotNull() & (F.date_format(when, "HH:mm:ss") != "00:00:00"))
    return dedupe_ids(out.withColumn("call_id", F.concat("ticker", F.lit("_"), F.col("year").cast("string"), F.lit("Q"), F.col("quarter").cast("string"))), "call_id", ordinal)


def dedupe_ids(df: DataFrame, column: str, ordinal: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(column).orderBy(ordinal))
    return df.withColumn("_n", n).withColumn(column, F.when(F.col("_n") == 1, F.col(column)).otherwise(F.concat(column, F.lit("_"), F.col("_n").cast("string")))).drop("_n")


def explode_payload(calls: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, utterance_idx, speaker, text, n_chars) of payloads that are JSON lists of objects; items without text are left
    out before they are numbered; anything else has none."""
    items = F.from_json(payload, "array<map<string,string>>", {"mode": "PERMISSIVE"})

    def pick(item, names):
        return F.coalesce(*(F.try_element_at(item, F.lit(n)) for n in names))

    parsed = F.transform(F.coalesce(items, F.array().cast("array<map<string,string>>")), lambda m: F.struct(F.trim(pick(m, SPEAKER_NAMES)).alias("speaker"), F.trim(pick(m, TEXT_NAMES)).alias("text")))
    kept = F.filter(parsed, lambda u: F.coalesce(u["text"], F.lit("")) != "")
    return calls.select(key, F.posexplode(kept).alias("utterance_idx", "u")).select(key, "utterance_idx", F.col("u")["speaker"].alias("speaker"), F.col("u")["text"].alias("text"), F.length(F.col("u")["text"]).alias("n_chars"))


def quality_filter(utterances: DataFrame, chars: int = 500, count: int = 5) -> tuple[DataFrame, DataFrame]:
    """Utterances of calls with enough text and utterances, and one row of counts: kept, short (which goes first), few."""
    per = utterances.groupBy("call_id").agg(F.sum("n_chars").alias("c"), F.count("*").alias("n"))
    per = per.withColumn("why", F.when(F.col("c") < chars, "short").when(F.col("n") < count, "few").otherwise("kept"))
    report = per.agg(*(F.count(F.when(F.col("why") == w, 1)).alias(w) for w in ("kept", "short", "few")))
    return utterances.join(per.filter("why = 'kept'").select("call_id"), "call_id", "left_semi"), report


def eligible(scored: DataFrame, chars: int = 20) -> DataFrame:
    return scored.filter(F.col("role").isin("management", "analyst") & (F.col("n_chars") >= chars) & (F.trim("text") != ""))


def check_utterances(utterances: DataFrame) -> DataFrame:
    """utterances, if they have rows, a call_id each and no (call_id, utterance_idx) twice; else ValueError."""
    keyed = utterances.groupBy("call_id", "utterance_idx").count()
    rows, nulls, most = keyed.agg(F.sum("count"), F.sum(F.when(F.col("call_id").isNull(), F.col("count")).otherwise(0)), F.max("count")).first()
    if not rows:
        raise ValueError("no utterances")
    if nulls:
        raise ValueError(f"{nulls} utterances have no call_id")
    if most > 1:
        raise ValueError("a call_id and utterance_idx come twice")
    return utterances


def infer_roles(utterances: DataFrame, strong: list[str], weak: list[str], veto: list[str], intro: str, operator: str = "operator") -> DataFrame:
    """Adds section, role and operator_confirmed to utterances (call_id, utterance_idx, speaker, text).

    Questions open at the first row of the operator that has no veto marker and a strong one, or a weak one after a named
    speaker, or at the first speaker with a Q or A prefix. Prefixes decide roles first, but for the operator; a person, told by
    match key, who spoke before the questions is management; others are analysts, and without questions nobody is.
    operator_confirmed: the operator announced that match key within the questions. Windows run within calls."""
    if not strong:
        raise ValueError("no strong markers: questions would never open")
    by = Window.partitionBy("call_id")
    before = by.orderBy("utterance_idx").rowsBetween(Window.unboundedPreceding, -1)
    u = utterances.withColumn("_name", T.clean_name(F.col("speaker")))
    u = u.withColumn("_key", T.match_key_of(F.col("_name"))).withColumn("_op", F.col("_name") == operator.strip().lower()).withColumn("_pre", T.prefix_role(F.col("speaker")))
    named = F.coalesce(F.max((~F.col("_op") & (F.col("_name") != "")).cast("int")).over(before), F.lit(0)) == 1
    opens = F.col("_op") & ~T.any_marker(F.col("text"), veto) & (T.any_marker(F.col("text"), strong) | (T.any_marker(F.col("text"), weak) & named))
    u = u.withColumn("_opens", F.coalesce(opens, F.lit(False)) | F.col("_pre").isNotNull())
    u = u.withColumn("_start", F.min(F.when(F.col("_opens"), F.col("utterance_idx"))).over(by))
    u = u.withColumn("_qa", F.coalesce(F.col("utterance_idx") >= F.col("_start"), F.lit(False)))
    person = Window.partitionBy("call_id", "_key")
    spoke = F.max((~F.col("_qa") & ~F.col("_op") & (F.col("_key") != "")).cast("int")).over(person) == 1
    told = F.when(F.col("_op") & F.col("_qa"), T.announced(F.col("text"), intro))
    keys = F.transform(F.flatten(F.collect_list(told).over(by)), lambda n: T.match_key_of(T.clean_name(n)))
    u = u.withColumn("_spoke", spoke).withColumn("_told", keys)
    prefixed = F.when(~F.col("_op"), F.col("_pre"))
    role = F.when(F.col("_op"), "operator").when(prefixed.isNotNull(), prefixed).when(F.col("_name") == "", "unknown").when(F.col("_spoke"), "management").otherwise("analyst")
    confirmed = (F.col("_key") != "") & F.array_contains("_told", F.col("_key"))
    return u.withColumns({"section": F.when(F.col("_qa"), "qa").otherwise("remarks"), "role": role, "operator_confirmed": F.coalesce(confirmed, F.lit(False))}).select(*utterances.columns, "section", "role", "operator_confirmed")


def role_coverage(roles: DataFrame) -> DataFrame:
    """One row: calls, calls with questions, the share of utterances but the operator's that have a role, and numbers by role."""
    sure = F.col("role").isin("management", "analyst")
    return roles.agg(
        F.countDistinct("call_id").alias("calls"),
        F.countDistinct(F.when(F.col("section") == "qa", F.col("call_id"))).alias("calls_with_qa"),
        F.avg(F.when(F.col("role") != "operator", sure.cast("double"))).alias("classified"),
        *(F.count(F.when(F.col("role") == r, 1)).alias(r) for r in ("management", "analyst", "operator", "unknown")),
    )


def first_heard(roles: DataFrame, by: list[str], order: str, columns: list[str], cut: str | None = None, most: int = 200) -> DataFrame:
    """Per group the first non-null value of each column by order; the text column `cut` at `most` characters."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    out = roles.groupBy(*by).agg(*(first(c) for c in columns))
    return out.withColumn(cut, F.substring(cut, 1, most)) if cut else out


def residual_roles(utterances: DataFrame, titles: str) -> DataFrame:
    """Roles of headers "Name -- Affiliation": operator, analyst if the header ends with it, manager by a title in the
    affiliation; the rest are managers if the call hears them in remarks, else analysts. utterances has section."""
    header = F.trim(F.coalesce("speaker", F.lit("")))
    rest = F.array_join(F.slice(F.split(header, "--"), 2, 1000), " ")
    rule = F.when(F.lower(header) == "operator", "operator").when(F.lower(header).endswith("analyst"), "analyst").when(rest.rlike("(?i)" + titles), "manager")
    u = utterances.withColumn("_rule", rule)
    heard = F.max((F.col("_rule").isNull() & (F.col("section") == "remarks")).cast("int")).over(Window.partitionBy("call_id", "speaker")) == 1
    return u.withColumn("role", F.coalesce("_rule", F.when(heard, "manager").otherwise("analyst"))).drop("_rule")


def parse_transcripts(calls: DataFrame, key: str, text: str) -> DataFrame:
    """(key, utterance_idx, speaker, section, text) of plain transcripts: section lines, "Name -- Affiliation" or Operator lines that
    name who speaks next, a duration line that ends a speaker. Lines before any speaker belong to nobody; utterances without
    text are left out before they are numbered. Line numbers and utterances stay within their call's row."""
    lines = calls.select(key, F.posexplode(F.split(text, "\n")).alias("_i", "_l"))
    name = r"^\s*([A-Z][^\n]{1,80}?)\s*--\s*([^\n]{2,100})\s*$"
    kind = (
        F.when(F.col("_l").rlike(r"(?i)^\s*Prepared Remarks:?\s*$"), "remarks")
        .when(F.col("_l").rlike(r"(?i)^\s*Questions\s*(?:&|and)\s*Answers:?\s*$"), "qa")
        .when(F.col("_l").rlike(r"(?i)^\s*Duration:\s"), "end")
        .when(F.col("_l").rlike(r"(?i)^\s*Operator\s*$"), "operator")
        .when(F.col("_l").rlike(name), "name")
    )
    lines = lines.withColumn("_k", kind)
    w = Window.partitionBy(key).orderBy("_i")
    full = F.concat_ws(" -- ", F.trim(F.regexp_extract("_l", name, 1)), F.trim(F.regexp_extract("_l", name, 2)))
    speaker = F.when(F.col("_k") == "operator", "Operator").when(F.col("_k") == "name", full).when(F.col("_k") == "end", "")
    lines = lines.withColumns({
        "_block": F.count("_k").over(w),
        "speaker": F.nullif(F.last(speaker, True).over(w), F.lit("")),
        "section": F.coalesce(F.last(F.when(F.col("_k").isin("remarks", "qa"), F.col("_k")), True).over(w), F.lit("remarks")),
    })
    said = lines.filter("_k is null and speaker is not null and trim(_l) != ''").groupBy(key, "_block", "speaker", "section")
    said = said.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.trim("_l").alias("l")))), lambda x: x["l"]), " ").alias("text"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("_block")) - 1
    return said.withColumn("utterance_idx", number).select(key, "utterance_idx", "speaker", "section", "text")


def combine_times(df: DataFrame, date: str, time: str | None = None, zone: str = "US/Eastern") -> DataFrame:
    """Adds call_datetime, the UTC instant of local text (date and time, or one column of both), and has_time. What doesn't parse
    is null; midnight counts as no time; hours that clocks skip or repeat go as in times.localise."""
    text = F.concat_ws(" ", F.col(date).cast("string"), F.col(time).cast("string")) if time else F.col(date).cast("string")
    local = F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")))
    return df.withColumn("_l", local).withColumns({"call_datetime": times.localise(F.col("_l"), zone), "has_time": F.coalesce(F.date_format("_l", "HH:mm:ss") != "00:00:00", F.lit(False))}).drop("_l")


def canonical(df: DataFrame, column: str, aliases: dict[str, str], keep: str | None = None) -> DataFrame:
    """Old names to new ones, one step; with keep the old name stays in that column."""
    if keep:
        df = df.withColumn(keep, F.col(column))
    if not aliases:
        return df
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return df.withColumn(column, F.coalesce(F.try_element_at(known, F.col(column)), F.col(column)))


def in_period(df: DataFrame, day: str, first=None, last=None) -> DataFrame:
    """Rows from first to last, both included; without a day in neither."""
    df = df.filter(F.col(day).isNotNull())
    df = df if first is None else df.filter(F.to_date(day) >= F.lit(first).cast("date"))
    return df if last is None else df.filter(F.to_date(day) <= F.lit(last).cast("date"))


def ordered_distinct(df: DataFrame, column: str, order: str) -> DataFrame:
    """(column, order) of each value's first row."""
    return df.groupBy(column).agg(F.min(order).alias(order)).orderBy(order)


def priority_shuffle(df: DataFrame, key: str, first: Column, seed: int = 42) -> DataFrame:
    """Rows in a fixed random order, those where `first` holds before all others."""
    return df.orderBy(F.when(first, 0).otherwise(1), F.xxhash64(F.col(key), F.lit(seed)), key)


def sample_groups(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Rows of n groups, those of the smallest hashes."""
    chosen = df.select(key).distinct().orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
    return df.join(chosen, key, "left_semi")


def quota_sample(df: DataFrame, by: str, key: str, quota: int, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= quota).drop("_r")


def resolve_universe(sets: dict[str, DataFrame], key: str, order: list[str]) -> DataFrame:
    """A row per key of any set, a flag for each set, and layer: the first set in `order` that holds it."""
    out = None
    for name, df in sets.items():
        one = df.select(key).distinct().withColumn(f"in_{name}", F.lit(True))
        out = one if out is None else out.join(one, key, "full")
    out = out.fillna(False)
    layer = F.lit(None).cast("string")
    for name in reversed(order):
        layer = F.when(F.col(f"in_{name}"), name).otherwise(layer)
    return out.withColumn("layer", layer)


def programmatic_net(df: DataFrame, extra: list[str], vetoed: list[str], sectors: list[str], industries: list[str]) -> DataFrame:
    """Tickers by explicit extra, else not of a vetoed industry and of an allowed sector or industry."""
    return df.filter(F.when(F.col("ticker").isin(extra), True).when(F.col("industry").isin(vetoed), False).otherwise(F.coalesce(F.col("sector").isin(sectors) | F.col("industry").isin(industries), F.lit(False))))


def candidate_universe(curated: dict[str, DataFrame], net: DataFrame, blocks: DataFrame, delisted: DataFrame, present: DataFrame) -> DataFrame:
    """A row per candidate ticker: in_core (curated or of the net, and of no block), sensitivity_block, is_delisted, layer, in_dataset.

    blocks (ticker, block): of several the least. The layer is that of the block, else the first curated list, else the net."""
    block = blocks.groupBy("ticker").agg(F.min("block").alias("sensitivity_block"))
    flags = resolve_universe({**curated, "net": net, "delisted": delisted, "block": block}, "ticker", [*curated, "net", "delisted"])
    out = flags.join(block, "ticker", "left").join(present.select("ticker").distinct().withColumn("in_dataset", F.lit(True)), "ticker", "left")
    named = F.greatest(*(F.col(f"in_{c}") for c in curated), F.col("in_net"))
    return out.select(
        "ticker",
        (named & F.col("sensitivity_block").isNull()).alias("in_core"),
        "sensitivity_block",
        F.col("in_delisted").alias("is_delisted"),
        F.when(F.col("sensitivity_block").isNotNull(), F.concat(F.lit("sensitivity:"), "sensitivity_block")).otherwise(F.col("layer")).alias("layer"),
        F.coalesce("in_dataset", F.lit(False)).alias("in_dataset"),
    )


def select_tickers(universe: DataFrame, blocks: list[str]) -> DataFrame:
    """Tickers of a run in order: those in the data that are core, delisted or of an active block."""
    active = F.coalesce(F.col("sensitivity_block").isin(blocks), F.lit(False)) if blocks else F.lit(False)
    return universe.filter(F.col("in_dataset") & (F.col("in_core") | F.col("is_delisted") | active)).select("ticker").orderBy("ticker")


def confusion(df: DataFrame, gold: str, predicted: str, classes: list) -> DataFrame:
    """Rows by gold class, a column for each predicted one, and recall."""
    out = df.groupBy(F.col(gold).alias("gold")).pivot(predicted, classes).count().fillna(0)
    hit = F.lit(0)
    for c in classes:
        hit = F.when(F.col("gold") == c, F.col(f"`{c}`")).otherwise(hit)
    total = sum((F.col(f"`{c}`") for c in classes), F.lit(0))
    return out.withColumn("recall", F.try_divide(hit, total))


def class_scores(df: DataFrame, gold: str, predicted: str, classes: list) -> DataFrame:
    """A row per class: support, predicted, hits, precision, recall, and the accuracy over rows of the classes."""
    known = df.filter(F.col(gold).isin(classes) & F.col(predicted).isin(classes))
    each = known.withColumn("class", F.explode(F.array_distinct(F.array(F.col(gold), F.col(predicted)))))
    g, p = F.col(gold) == F.col("class"), F.col(predicted) == F.col("class")
    out = each.groupBy("class").agg(F.count_if(g).alias("support"), F.count_if(p).alias("predicted"), F.count_if(g & p).alias("hits"))
    total = Window.partitionBy()  # a row per class
    return out.withColumns({
        "precision": F.try_divide("hits", "predicted"),
        "recall": F.try_divide("hits", "support"),
        "accuracy": F.try_divide(F.sum("hits").over(total), F.sum("support").over(total)),
    })


def most_frequent(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column) with each key's most frequent non-null value, the least of equals. Counted before keys meet."""
    n = df.filter(F.col(column).isNotNull()).groupBy(key, column).count()
    return n.groupBy(key).agg(F.min_by(column, F.struct(-F.col("count"), F.col(column))).alias(column))


def header_summary(utterances: DataFrame, header: str, ticker: str, text: str, most: int = 4) -> DataFrame:
    """Per header: utterances, companies, the first `most` of them in order as text, and the longest text (the least of equals)."""
    distinct = utterances.groupBy(header, ticker).agg(F.count("*").alias("n"), F.min(F.struct(-F.length(text), F.col(text))).alias("t"))
    place = F.row_number().over(Window.partitionBy(header).orderBy(F.col(ticker).asc_nulls_last()))
    distinct = distinct.withColumn("r", place)
    return distinct.groupBy(header).agg(
        F.sum("n").alias("n_utterances"),
        F.count(ticker).alias("n_tickers"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("r") <= most, F.col(ticker)))), ",").alias("tickers"),
        F.min("t")[text].alias("example"),
    )
