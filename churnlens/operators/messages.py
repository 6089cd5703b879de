"""Retention-campaign text as set-based columns (STR3-8, JON7, AGG8, TOP2).

No text generation service is called: prompts become a *request table*, and
responses come back as a table joined by key. All text is built with built-in
string functions (``concat``, ``array_join``, ``transform``), so it runs in the
JVM next to the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.scalars import fixed_text, percent_text, strip_all, word_count
from churnlens.schema import HIGH_RISK, ID_COL, SCORE_COL

# Campaign texts are this library's own configuration: data cards of key=value lines, so that a service
# gets the fields STR3-5 name and nothing to parse.
UNKNOWN = "n/a"
DEFAULT_NAME = "customer"
TONES = {
    "warm": "friendly, first person",
    "formal": "courteous and factual",
    "short": "under sixty words",
}
DEFAULT_TONE = "warm"
MAIL_SYSTEM_PROMPT = (
    "Draft a note that an account manager can send unchanged. Use the data card as background only: quote no score "
    "and no field name. Offer one benefit that fits the recorded contract, for example a waived fee or a free month.")
SUMMARY_SYSTEM_PROMPT = "Condense account lists for the weekly service review. Numbers first, opinions last."
PROMPT_HEAD = "[data card: retention note]"
PROMPT_TAIL = "answer=subject line, blank line, body"
SUMMARY_HEAD = "[data card: accounts at risk]"
SUMMARY_TAIL = "answer=what the accounts share, then next steps for the service desk"
ERROR_KEY = "service key refused"
ERROR_RATE = "service busy, retry later"
ERROR_OTHER = "service fault: "
FALLBACK_TEMPLATE = (
    "(standard note; {detail})\n\nHello,\nyour account manager would like to talk with you about your plan this week. "
    "Until then nothing changes on your bill.\nThe service desk")

# --- Fixed values: generation settings (most tokens, temperature), list length, reading speed ---
MAIL_SETTINGS = (500, 0.7)
SUMMARY_SETTINGS = (800, 0.5)
SUMMARY_TOP = 10
WORDS_PER_MINUTE = 200
# --- end of fixed values ---


def _or_unknown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(UNKNOWN))


def tone_note(tone: Column) -> Column:
    """Tone instruction; unknown tones fall back to the default tone."""
    m = F.create_map(*[x for k, v in TONES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[tone], F.lit(TONES[DEFAULT_TONE]))


def factor_lines(factors: Column) -> Column:
    """One 'driver.<i>=<feature>; <direction>; <|phi| with 3 decimals>' line per factor."""
    return F.transform(factors, lambda f, i: F.concat(
        F.lit("driver."), (i + 1).cast("string"), F.lit("="), f["feature"], F.lit("; "), f["direction"], F.lit("; "),
        fixed_text(F.abs(f["shap_value"]), 3)))


def retention_prompt(df: DataFrame, factors: DataFrame, tone: str | Column = DEFAULT_TONE,
                     name: str | Column | None = None, p: str = SCORE_COL) -> DataFrame:
    """STR3: one prompt per customer from raw columns, score and top factors.

    ``df`` holds customerID, the score and raw columns (tenure, MonthlyCharges,
    Contract as recorded, not scaled); ``factors`` is the array form of XAI4.
    """
    tone_c = F.lit(tone) if isinstance(tone, str) else tone
    name_c = F.lit(DEFAULT_NAME) if name is None else (F.lit(name) if isinstance(name, str) else name)
    cols = set(df.columns)
    tenure = _or_unknown(F.col("tenure")) if "tenure" in cols else F.lit(UNKNOWN)
    monthly = F.coalesce(fixed_text("MonthlyCharges", 2), F.lit(UNKNOWN)) if "MonthlyCharges" in cols \
        else F.lit(UNKNOWN)
    contract = _or_unknown(F.col("Contract")) if "Contract" in cols else F.lit(UNKNOWN)
    j = df.join(factors, ID_COL, "left")
    empty = F.array().cast("array<struct<feature:string,shap_value:double,direction:string>>")
    prompt = F.concat_ws(
        "\n", F.lit(PROMPT_HEAD),
        F.concat(F.lit("score="), F.coalesce(percent_text(p), F.lit(UNKNOWN))),
        F.concat(F.lit("contract="), contract),
        F.concat(F.lit("monthly="), monthly),
        F.concat(F.lit("tenure_months="), tenure),
        factor_lines(F.coalesce(F.col("factors"), empty)),
        F.concat(F.lit("style="), tone_note(tone_c)),
        F.concat(F.lit("to="), F.coalesce(name_c, F.lit(DEFAULT_NAME))),
        F.lit(PROMPT_TAIL))
    return j.select(ID_COL, F.coalesce(tone_c, F.lit(DEFAULT_TONE)).alias("tone"), prompt.alias("user_prompt"))


def summary_input(df: DataFrame, threshold: float = HIGH_RISK, n: int = SUMMARY_TOP,
                  p: str = SCORE_COL) -> DataFrame:
    """AGG8 / TOP2: number of high-risk customers and the n riskiest (score desc, id)."""
    hr = df.where(F.col(p) >= F.lit(threshold))
    top = hr.orderBy(F.col(p).desc(), ID_COL).limit(n)  # TakeOrderedAndProject: n rows per partition
    keep = [c for c in ("tenure", "MonthlyCharges") if c in df.columns]
    listed = top.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col(p)).alias("_o"), F.col(ID_COL).alias("id"), F.col(p).alias("churn_prob"),
        *[F.col(c) for c in keep]))).alias("top"))
    return listed.select(hr.select(F.count(F.lit(1))).scalar().alias("n_high"),
                         F.transform("top", lambda x: x.dropFields("_o")).alias("top"))


def summary_prompt(summary: DataFrame) -> DataFrame:
    """STR4: management-summary prompt from AGG8; absent fields print as unknown."""
    def field(x, name):
        return F.coalesce(x[name].cast("string"), F.lit(UNKNOWN))
    lines = F.transform("top", lambda x, i: F.concat(
        F.lit("account."), (i + 1).cast("string"), F.lit("="), field(x, "id"),
        F.lit("; tenure "), field(x, "tenure"), F.lit("; monthly "),
        F.coalesce(fixed_text(x["MonthlyCharges"], 2), F.lit(UNKNOWN)),
        F.lit("; score "), F.coalesce(percent_text(x["churn_prob"]), F.lit(UNKNOWN))))
    return summary.select("n_high", F.concat_ws(
        "\n", F.lit(SUMMARY_HEAD), F.concat(F.lit("accounts="), F.col("n_high").cast("string")), lines,
        F.lit(SUMMARY_TAIL)).alias("user_prompt"))


def request_table(prompts: DataFrame, job: str = "mail") -> DataFrame:
    """STR8: request rows (system prompt, user prompt, max tokens, temperature); no call is made."""
    system, (max_tokens, temperature) = ((MAIL_SYSTEM_PROMPT, MAIL_SETTINGS) if job == "mail"
                                         else (SUMMARY_SYSTEM_PROMPT, SUMMARY_SETTINGS))
    return prompts.select("*", F.lit(job).alias("job"), F.lit(system).alias("system_prompt"),
                          F.lit(max_tokens).cast("int").alias("max_tokens"),
                          F.lit(temperature).cast("double").alias("temperature"))


def error_reason(err: Column) -> Column:
    """STR5: key / authentication (first test case-sensitive), rate limit, other."""
    low = F.lower(err)
    return (F.when(err.contains("API key") | low.contains("authentication"), F.lit(ERROR_KEY))
            .when(low.contains("rate limit"), F.lit(ERROR_RATE))
            .otherwise(F.concat(F.lit(ERROR_OTHER), err)))


def fallback_message(err: Column) -> Column:
    head, tail = FALLBACK_TEMPLATE.split("{detail}")
    return F.concat(F.lit(head), error_reason(err), F.lit(tail))


def attach_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """JON7 + STR5 + STR7: left join on key; a trimmed response, or the fallback text, per response.
    Further response columns (a turn number) are kept."""
    extra = [c for c in responses.columns if c not in requests.columns and c not in ("response", "error")]
    r = responses.select(ID_COL, "response", "error", *extra)
    j = requests.join(r, ID_COL, "left")
    ok = F.col("response").isNotNull()
    return j.select("*", F.when(ok, strip_all(F.col("response")))
                    .otherwise(fallback_message(F.coalesce(F.col("error"), F.lit("no response"))))
                    .alias("message"),
                    F.when(ok, F.lit("ok")).otherwise(F.lit("fallback")).alias("outcome"))


def message_stats(df: DataFrame, text: str = "message") -> DataFrame:
    """STR6: words, characters and reading minutes max(1, round-half-even(words / 200))."""
    w = word_count(text)
    return df.withColumns({"words": w, "chars": F.length(text),
                           "read_minutes": F.greatest(F.lit(1), F.bround(w / F.lit(float(WORDS_PER_MINUTE)), 0)
                                                      .cast("int"))})


def trim_response(df: DataFrame, text: str = "response") -> DataFrame:
    """STR7: strip leading and trailing whitespace of any kind."""
    return df.withColumn(text, strip_all(text))
