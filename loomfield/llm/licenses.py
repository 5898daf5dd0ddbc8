"""License scans with ordered signature rules, in DataFrame functions alone.

A text is first cut to its words (lower case, one space between them), so that a rule sees neither punctuation nor
line breaks. A document without any licence keyword is done there. For the rest a rule runs only if a keyword of its form
and one of its name stand in the words. Of the spans found, one that lies within another is suppressed: the longer one wins, and of equal
spans the rule of higher priority. Everything happens within a row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.base import ascii_lower, text_or_empty

#: Words of the original text: what isn't ASCII, digits and letters of either case.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What parts the words of a lower-cased text.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
BASE_RULE = "(?<= )(?:" + "|".join(p for p, _ in BASE) + ")(?= )"

#: (label, pattern of the name in words, keywords of which every match contains one, the spaces around it included)
NAMES: tuple[tuple[str, str, str], ...] = (
    ("mit", "mit", " mit "),
    ("mit", "expat", " expat "),
    ("mit", "x11", " x11 "),
    ("mit-0", "mit no attribution", "mit no attribution"),
    ("isc", "isc", "isc"),
    ("apache-1.0", "apache(?: software)?(?: license)?(?: version)? 1 0", "apache"),
    ("apache-1.1", "apache(?: software)?(?: license)?(?: version)? 1 1", "apache"),
    ("apache-2.0", "apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", "apache"),
    ("bsd-1-clause", "(?:bsd 1 clause|1 clause bsd|one clause bsd)", "bsd"),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd"),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "bsd"),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)", "bsd"),
    ("0bsd", "(?:0bsd|zero clause bsd|bsd zero clause)", "bsd"),
    ("gpl-1.0", "(?:gnu )?(?:gpl|general public license)(?: version| v)? ?1(?: 0)?", "gpl|general public"),
    ("gpl-2.0", "(?:gnu )?(?:gpl|general public license)(?: version| v)? ?2(?: 0)?", "gpl|general public"),
    ("gpl-3.0", "(?:gnu )?(?:gpl|general public license)(?: version| v)? ?3(?: 0)?", "gpl|general public"),
    ("lgpl-2.0", "(?:gnu )?(?:lgpl|library general public license)(?: version| v)? ?2(?: 0)?", "lgpl|library general"),
    ("lgpl-2.1", "(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?2 1", "lgpl|lesser general"),
    ("lgpl-3.0", "(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?3(?: 0)?", "lgpl|lesser general"),
    ("agpl-3.0", "(?:gnu )?(?:agpl|affero general public license)(?: version| v)? ?3(?: 0)?", "agpl|affero general"),
    ("gfdl", "(?:gnu )?(?:gfdl|free documentation license)(?: version)?(?: 1 [0-9])?", "gfdl|free documentation"),
    ("mpl-1.1", "(?:mpl|mozilla public license)(?: version| v)? ?1 1", "mpl|mozilla public"),
    ("mpl-2.0", "(?:mpl|mozilla public license)(?: version| v)? ?2(?: 0)?", "mpl|mozilla public"),
    ("epl-1.0", "(?:epl|eclipse public license)(?: version| v)? ?1(?: 0)?", "epl|eclipse public"),
    ("epl-2.0", "(?:epl|eclipse public license)(?: version| v)? ?2(?: 0)?", "epl|eclipse public"),
    ("cddl-1.0", "(?:cddl|common development and distribution license)(?: version| v)?(?: 1(?: 0)?)?", "cddl|common development"),
    ("cpl-1.0", "common public license(?: version| v)?(?: 1(?: 0)?)?", "common public"),
    ("eupl-1.2", "(?:eupl|european union public licen[cs]e)(?: version| v)?(?: 1 2)?", "eupl|european union"),
    ("artistic-1.0", "artistic license(?: version)? 1(?: 0)?", "artistic"),
    ("artistic-2.0", "artistic license(?: version)? 2(?: 0)?", "artistic"),
    ("bsl-1.0", "boost software license(?: version)?(?: 1 0)?", "boost"),
    ("busl-1.1", "business source license(?: version)?(?: 1 1)?", "business source"),
    ("sspl-1.0", "(?:sspl|server side public license)(?: version)?(?: 1)?", "sspl|server side"),
    ("elastic-2.0", "elastic license(?: version)?(?: 2 0)?", "elastic"),
    ("zlib", "zlib(?: libpng)?", "zlib"),
    ("unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("postgresql", "postgresql", "postgresql"),
    ("python-2.0", "(?:python software foundation|psf)(?: license)?(?: version)?(?: 2)?", "psf|python software"),
    ("openssl", "openssl", "openssl"),
    ("ofl-1.1", "(?:sil )?open font license(?: version)?(?: 1 1)?", "open font"),
    ("odbl-1.0", "(?:odbl|open (?:data commons )?open database license|open database license)(?: version| v)?(?: 1 0)?", "odbl|open database|open data commons"),
    ("odc-by-1.0", "open data commons attribution(?: license)?", "open data commons"),
    ("cc0-1.0", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?", "cc0|cc zero|creative commons"),
    ("cc-by-2.0", "(?:cc by|creative commons attribution)(?: license)? 2 0", "cc by|creative commons"),
    ("cc-by-3.0", "(?:cc by|creative commons attribution)(?: license)? 3 0", "cc by|creative commons"),
    ("cc-by-4.0", "(?:cc by|creative commons attribution)(?: international)?(?: license)? 4 0", "cc by|creative commons"),
    ("cc-by-sa-3.0", "(?:cc by sa|creative commons attribution sharealike)(?: license)? 3 0", "cc by sa|creative commons"),
    ("cc-by-sa-4.0", "(?:cc by sa|creative commons attribution sharealike)(?: license)? 4 0", "cc by sa|creative commons"),
    ("cc-by-nc-3.0", "(?:cc by nc|creative commons attribution noncommercial)(?: license)? 3 0", "cc by nc|creative commons"),
    ("cc-by-nc-4.0", "(?:cc by nc|creative commons attribution noncommercial)(?: license)? 4 0", "cc by nc|creative commons"),
    ("cc-by-nd-4.0", "(?:cc by nd|creative commons attribution noderivatives)(?: license)? 4 0", "cc by nd|creative commons"),
    ("cc-by-nc-sa-4.0", "(?:cc by nc sa|creative commons attribution noncommercial sharealike)(?: license)? 4 0", "cc by nc|creative commons"),
    ("cc-by-nc-nd-4.0", "(?:cc by nc nd|creative commons attribution noncommercial noderivatives)(?: license)? 4 0", "cc by nc|creative commons"),
    ("openrail", "(?:bigscience )?open ?rail(?: m)?", "rail"),
    ("proprietary", "proprietary", " proprietary "),
    ("proprietary", "commercial", " commercial "),
)
#: (name, pattern around a licence's name, keywords, priority, confidence), the most certain first.
FORMS: tuple[tuple[str, str, str, int, float], ...] = (
    ("identifier", "spdx license identifier {name}(?: only| or later)?", "spdx", 40, 0.99),
    ("notice", "(?:licensed|released|distributed|published|provided|covered)(?: [^ ]+){{0,2}}? (?:under|by)(?: the)?(?: terms of)?(?: the)?(?: conditions of the)? {name}(?: licen[cs]e)?", "licensed |released |distributed |published |provided |covered ", 30, 0.95),
    ("notice_is", "available(?: [^ ]+){{0,2}}? (?:under|by)(?: the)?(?: terms of)?(?: the)?(?: conditions of the)? {name}(?: licen[cs]e)?", "available ", 30, 0.95),
    ("notice_available", "available under(?: the)?(?: terms of)?(?: the)? {name}(?: licen[cs]e)?", "available under", 25, 0.9),
    ("terms", "(?:subject to|governed by|terms of|according to|complies with)(?: the)? {name}(?: licen[cs]e)?", "subject to|governed by|terms of|according to|complies with", 20, 0.8),
    ("reference", "{name} licen[cs]e", "licen", 10, 0.6),
)
#: Breaks within the gate, which sees the original text.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Every match of a rule has one of these, by its form, and every base phrase the first; a document without them is not looked at.
GATE = (
    "(?i)licen[cs]e|spdx|(?:(?:licensed|released|distributed|published|available|provided|covered)"
    f"|subject{_GAP}to|governed{_GAP}by|terms{_GAP}of|according{_GAP}to|complies{_GAP}with){_GAP}"
)


def rules() -> list[tuple[str, str, int, float]]:
    """(label, pattern, priority, confidence) for every form of every name."""
    return [(label, form.format(name=name), priority, sure) for _, form, _, priority, sure in FORMS for label, name, _ in NAMES]


def _gated(words: Column) -> Column:
    """The rules whose form and whose name have a keyword in the words; each keyword is looked for once."""
    texts = lambda kw: F.array(*map(F.lit, kw.split("|")))
    names = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(rx).alias("name"), texts(kw).alias("kw")) for label, rx, kw in NAMES))
    forms = F.array(*(F.struct(F.lit(rx.replace("{{", "{").replace("}}", "}")).alias("form"), texts(kw).alias("kw"), F.lit(p).alias("priority"), F.lit(c).alias("sure")) for _, rx, kw, p, c in FORMS))
    there = lambda rows: F.filter(rows, lambda r: F.exists(r["kw"], lambda k: F.contains(words, k)))
    pattern = lambda f, n: F.concat(F.lit("(?<= )(?:"), F.replace(f["form"], F.lit("{name}"), n["name"]), F.lit(")(?= )"))
    rule = lambda f, n: F.struct(n["label"].alias("label"), pattern(f, n).alias("pattern"), f["priority"].alias("priority"), f["sure"].alias("sure"))
    named = there(names)
    return F.when(F.size(named) > 0, F.flatten(F.transform(there(forms), lambda f: F.transform(named, lambda n: rule(f, n))))).otherwise(F.array())


def words_of(text: Column) -> Column:
    """The words between single spaces, with a space at either end; one space if there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), BREAKS, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _spans(words: Column, rule: Column) -> Column:
    """All matches of a rule with the numbers of their first word and of the word after their last."""
    between, found = F.split(words, rule["pattern"], -1), F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    empty = F.expr("cast(array() as array<struct<start:int,stop:int,priority:int,label:string,sure:double>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + _spaces(x["before"])
        stop = start + _spaces(x["match"]) + 1
        span = F.struct(start.alias("start"), stop.alias("stop"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["sure"].alias("sure"))
        return F.struct((stop - 1).alias("at"), F.array_append(acc["out"], span).alias("out"))

    # before the first match stands one space more than words
    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(b.alias("before"), m.alias("match")))
    return F.aggregate(pairs, F.struct(F.lit(-1).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def _uncontained(spans: Column) -> Column:
    """Spans in order, without those that lie within another."""
    order = F.array_sort(
        spans,
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["stop"] != b["stop"], b["stop"] - a["stop"]).when(a["priority"] != b["priority"], b["priority"] - a["priority"])
        .when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0),
    )
    empty = F.expr("cast(array() as array<struct<start:int,stop:int,priority:int,label:string,sure:double>>)")
    step = lambda acc, s: F.when(s["stop"] <= acc["far"], acc).otherwise(F.struct(s["stop"].alias("far"), F.array_append(acc["out"], s).alias("out")))
    return F.aggregate(order, F.struct(F.lit(-1).alias("far"), empty.alias("out")), step, lambda acc: acc["out"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, spans, labels, score.

    Words and base phrases are as the contract has them. spans: array<struct<start, stop, priority, label, sure>>, the
    rules' detections after suppression, in words. labels: base labels and those of spans, distinct, sorted, joined by
    commas. score: 1 - the product of (1 - sure) over spans, each label once, and at least 0.5 with a base phrase.
    A null or empty text has no words: 0, nulls and empty strings. Ids may be null or repeat; each row is scanned alone. Other columns are ignored.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("id", F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n_words"), F.when(text.rlike(GATE), words_of(text)).otherwise(F.lit(" ")).alias("words"))
    words = F.col("words")
    rows = rows.withColumn("rules", F.when(words != " ", _gated(words)))
    rows = rows.withColumns(
        {
            "spans": F.when(words == " ", F.array()).otherwise(F.flatten(F.transform("rules", lambda r: _spans(words, r)))),
            "n_base": F.regexp_count(words, F.lit(BASE_RULE)).cast("long"),
            "before_first": F.regexp_extract(words, f"(?s)^(.*?){BASE_RULE}", 1),
            "before_last": F.regexp_extract(words, f"(?s)^(.*){BASE_RULE}", 1),
            "base": F.array_compact(F.array(*(F.when(F.contains(words, F.lit(f" {p} ")), F.lit(label)) for p, label in BASE))),
        }
    )
    rows = rows.withColumn("spans", _uncontained(F.col("spans")))
    where = lambda c: F.when(F.col("n_base") > 0, (_spaces(F.col(c)) - 1).cast("long"))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("base"), F.transform("spans", lambda s: s["label"]))))
    certain = F.aggregate(F.array_distinct(F.transform("spans", lambda s: F.struct(s["label"].alias("l"), s["sure"].alias("c")))), F.lit(1.0), lambda a, x: a * (1 - x["c"]))
    return rows.select(
        F.col("id").alias(id_col), "n_words", "n_base", where("before_first").alias("first_word"), where("before_last").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(1 - certain, F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"), "spans",
    )
