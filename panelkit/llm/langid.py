"""Language identification by Bayesian evidence fusion.

A character-trigram model, fitted on a bounded sample of labelled documents,
gives text likelihoods. Grouped aggregation over all pages gives how declared
markup languages and address suffixes go with the language of the text, and the
language counts of hosts, which are smoothed towards their domain, and that
towards all pages. The posterior adds up the logarithms.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.shared import pinned
from panelkit.llm.textscan import chunks, text_buffer

#: Distinct labelled texts of each language that the text model is fitted on, at most.
SAMPLE_TEXTS = 1_250
#: Labels whose counts may be broadcast.
BROADCAST_LANGUAGES = 10_000
#: The declared language of a page; bounded, so that a page full of opening tags takes no long scan from each.
DECLARED = r"(?i)<html\b[^>]{0,1000}?\blang\s{0,20}=\s{0,20}[\"']?([A-Za-z]{2,3})"
_BUCKETS = 1 << 14
#: Trigrams of a page that count in full; more evidence than this is scaled down, as trigrams are not independent.
EVIDENCE = 60.0
#: Pseudo-counts of a host towards its domain, of a domain towards all pages, of a suffix or declaration towards all pages.
HOST_WEIGHT, DOMAIN_WEIGHT, SIGNAL_WEIGHT = 5.0, 10.0, 20.0


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Hash bucket of the byte trigram that starts at each byte but the last two; case of ASCII letters aside."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64)
    mixed = (low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(18)).astype(np.int64)


@dataclass
class TextModel:
    """Log-probabilities of trigram buckets, one row per language of ``languages``."""

    languages: list[str]
    logs: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Log-likelihood of each text by language, of trigrams within the text, tempered beyond ``EVIDENCE`` of them."""
        data, offsets = text_buffer(texts)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for low, high in chunks(offsets):
            part, edges = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            found = _trigrams(part)
            at = np.minimum(edges, len(found))
            inside = np.ones(len(found), bool)
            for back in (1, 2):
                cut = edges[1:-1] - back
                inside[cut[(cut >= 0) & (cut < len(found))]] = False
            count = np.concatenate([[0], np.cumsum(inside)])
            n = np.maximum(count[at[1:]] - count[at[:-1]], 0)
            for k in range(len(self.languages)):
                sums = np.concatenate([[0.0], np.cumsum(np.where(inside, self.logs[k][found], 0.0))])
                out[low:high, k] = sums[at[1:]] - sums[at[:-1]]
            out[low:high] *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
        return out


def fit(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> TextModel:
    """A text model from at most ``sample_texts`` distinct whole texts of each ``lang``, picked by a hash of their content."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("lang", "text").alias("h"))
    # About twice the sample of a language passes a threshold of the hash, so that no task orders more than a few times its size.
    counts = pinned(labelled.groupBy(F.col("lang").alias("_lang")).agg(F.approx_count_distinct("h").alias("n")))
    # Broadcast, so that texts are thinned out where they are read; labels beyond any number of languages are joined.
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_LANGUAGES else counts
    share = F.least(F.lit(1.0), F.lit(2.0 * sample_texts + 100) / F.col("n")) * (1 << 30)
    passed = labelled.join(counts, F.col("lang") == F.col("_lang")).where(F.pmod("h", F.lit(1 << 30)) < share)
    # Copies of a text are one; the hash is of the whole text.
    one = passed.groupBy("lang", "h").agg(F.first("text").alias("text"))
    picked = one.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample_texts).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = np.bincount(_trigrams(np.frombuffer(text.encode(), np.uint8)), minlength=_BUCKETS)
                rows[lang] = rows.get(lang, 0) + seen
            for lang, seen in rows.items():
                at = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(seen[at])], ["lang", "bucket", "n"])

    counted = picked.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in counted})
    place = {lang: k for k, lang in enumerate(languages)}
    table = np.zeros((len(languages), _BUCKETS))
    for r in counted:
        table[place[r.lang], r.bucket] = r.n
    return TextModel(languages, np.log((table + 0.5) / (table + 0.5).sum(1, keepdims=True)))


_OPEN = re.compile(r"<(?:(script|style)\b|(!--))?", re.I)
_CLOSE = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style")}
#: A character reference of so many digits is no character, and too long for a number.
_ENDLESS = re.compile(r"&#[0-9]{9,};?")


def visible_text(html: str) -> str:
    """The text of a page without markup, scripts and comments; white space is single spaces.

    One scan forward: what a script, style or comment that is never closed hides goes to the end; a ``<`` without ``>`` is text.
    """
    out, at = [], 0
    while (m := _OPEN.search(html or "", at)) is not None:
        out.append(html[at : m.start()])
        if m[2]:
            end = html.find("-->", m.end())
            at = end + 3 if end >= 0 else len(html)
            continue
        end = html.find(">", m.end())
        if end < 0:
            at = m.start()
            break
        at = end + 1
        if m[1]:
            closed = _CLOSE[m[1].lower()].search(html, at)
            at = closed.end() if closed else len(html)
    out.append((html or "")[at:])
    return " ".join(html_entities.unescape(_ENDLESS.sub("\ufffd", " ".join(out))).split())


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """``page_id``, ``host``, ``domain``, ``suffix``, ``declared`` and ``logs`` (text log-likelihoods by language)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    key = pages.schema["page_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([visible_text(x) for x in batch.column(1).to_pylist()], pa.large_string())
            logs = pa.array(shared.value.scores(texts).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], logs], ["page_id", "host", "declared", "logs"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1))
    rows = pages.select("page_id", "html", host.alias("host"), declared.alias("declared")).mapInArrow(score, f"page_id {key}, host string, declared string, logs array<double>")
    return rows.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1))


def _best(values: Column, languages: list[str]) -> Column:
    """The language of the greatest value, the first in order on ties."""
    return F.element_at(F.array(*map(F.lit, languages)), F.array_position(values, F.array_max(values)).cast("int"))


def _counts(rows: DataFrame, by: str, languages: list[str], name: str) -> DataFrame:
    """``by`` and an array of page counts by text language; combined map-side, one row per value of ``by``."""
    return rows.groupBy(by).agg(F.array(*(F.sum((F.col("text_lang") == x).cast("double")) for x in languages)).alias(name))


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """``page_id``, ``lang``, ``posterior``, ``text_lang`` and ``declared`` per row of ``pages`` (``page_id``, ``url``, ``html``).

    A page's own count is taken out of its host and domain. A null or empty ``html`` has no text evidence, a null ``url`` the
    host ``''``; repeated rows are judged one by one. Without languages in the model every ``lang`` is null.
    """
    languages = model.languages
    if not languages:
        return pages.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"))
    rows = pinned(evidence(pages, model).withColumn("text_lang", _best(F.col("logs"), languages)))
    own = F.array(*((F.col("text_lang") == x).cast("double") for x in languages))
    total = rows.agg(*(F.sum((F.col("text_lang") == x).cast("double")) for x in languages)).first()
    prior = [((v or 0.0) + 1.0) for v in total]
    whole = F.array(*(F.lit(v / sum(prior)) for v in prior))
    # How often a language carries a signal, smoothed towards how often any page does: P(signal | language).
    joined = rows
    for signal in ("declared", "suffix"):
        joined = joined.join(_counts(rows, signal, languages, f"n_{signal}"), signal)
    joined = joined.join(_counts(rows, "domain", languages, "n_domain"), "domain").join(_counts(rows, "host", languages, "n_host"), "host")

    def sum_of(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def less_own(a: str) -> Column:
        return F.zip_with(F.col(a), own, lambda n, o: n - o)

    def smoothed(counts: Column, towards: Column, weight: float) -> Column:
        total = sum_of(counts) + weight
        return F.zip_with(counts, towards, lambda n, p: (n + weight * p) / total)

    joined = joined.withColumn("p_domain", smoothed(less_own("n_domain"), whole, DOMAIN_WEIGHT))
    joined = joined.withColumn("p_host", smoothed(less_own("n_host"), F.col("p_domain"), HOST_WEIGHT))
    logs = F.zip_with(F.col("logs"), F.col("p_host"), lambda a, p: a + F.ln(p))

    def ratios(signal: str) -> Column:
        """P(signal | language) over P(signal); a signal that says nothing adds nothing."""
        share = F.greatest(sum_of(F.col(f"n_{signal}")) - 1, F.lit(1.0)) / sum(prior)
        every = F.array(*(F.lit(v) for v in prior))
        return F.zip_with(less_own(f"n_{signal}"), every, lambda n, t: (n + SIGNAL_WEIGHT * share) / ((t + SIGNAL_WEIGHT) * share))

    for signal in ("declared", "suffix"):
        logs = F.when(F.col(signal) == "", logs).otherwise(F.zip_with(logs, ratios(signal), lambda a, r: a + F.ln(r)))
    joined = joined.withColumn("_logs", logs).withColumn("_top", F.array_max("_logs"))
    weights = F.transform("_logs", lambda x: F.exp(x - F.col("_top")))
    return joined.select("page_id", _best(F.col("_logs"), languages).alias("lang"), (1 / sum_of(weights)).alias("posterior"), "text_lang", "declared")
