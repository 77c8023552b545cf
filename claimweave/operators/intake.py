"""Self-descriptions read into contexts: age, gender, conditions, medications, goals and symptoms of whole tables of texts.

Phrases are found by one Aho-Corasick pass over a text, whatever their number; ordered patterns infer what
no phrase states.  Null and blank texts give a context without values, inferred fields or questions.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: phrases, patterns and texts that results depend on, in the order in which they are tried ----

#: Exact ways to say one's age; the first that gives 1 to 120 holds.
AGE_PATTERNS = [
    r"\b(?:i'?m|i am|age|turned|just turned)\s+([0-9]{1,3})\b",
    r"\b([0-9]{1,3})\s*(?:years?\s*old|y\.?o\.?|years? of age)\b",
    r"\b([0-9]{1,3})\s*[-–]\s*year[- ]old\b",
    r"(?:저는|나는)\s*([0-9]{1,3})\s*살",
    r"([0-9]{1,3})\s*살",
    r"([0-9]{1,3})\s*세\b",
    r"나이\s*([0-9]{1,3})",
    r"만\s*([0-9]{1,3})\s*(?:세|살)?",
]
#: After those: so many years, from 10 to 120.
YEARS_PATTERN = r"\b([0-9]{2,3})\s*years?\b"
#: Rough ages, each moved by the number; the first that gives 10 to 120 holds.
DECADE_PATTERNS = [
    (r"\b(?:in my\s+)?early\s+([0-9]0)s\b", 2),
    (r"\b(?:in my\s+)?mid(?:dle)?\s*[-–]?\s*([0-9]0)s\b", 5),
    (r"\b(?:in my\s+)?late\s+([0-9]0)s\b", 7),
    (r"\bin my\s+([0-9]0)s\b", 4),
    (r"\b([0-9]0)(?:s|-something)\b", 5),
    (r"\baround\s+([0-9]{2,3})\b", 0),
    (r"\babout\s+([0-9]{2,3})\b", 0),
    (r"\balmost\s+([0-9]{2,3})\b", -1),
    (r"([0-9]0)대\s*초반", 2),
    (r"([0-9]0)대\s*중반", 5),
    (r"([0-9]0)대\s*후반", 7),
    (r"([0-9]0)대", 4),
]
GENDER_WORDS = [
    ("female", "female"), ("woman", "female"), ("f", "female"), ("male", "male"), ("man", "male"), ("m", "male"),
    ("non-binary", "non-binary"), ("nonbinary", "non-binary"), ("nb", "non-binary"),
    ("여성", "female"), ("여자", "female"), ("남성", "male"), ("남자", "male"),
]
GENDER_PRONOUNS = [(r"\b(?:she|her)\b", "female"), (r"\b(?:he|him|his)\b", "male")]
#: (phrase, field, term): Latin phrases count as whole words, Korean ones anywhere.
PHRASES = [
    ("type 2 diabetes", "conditions", "Type 2 diabetes"), ("t2dm", "conditions", "Type 2 diabetes"), ("type 2 diabetes mellitus", "conditions", "Type 2 diabetes"),
    ("prediabetes", "conditions", "Prediabetes"), ("pre diabetes", "conditions", "Prediabetes"), ("pre-diabetes", "conditions", "Prediabetes"),
    ("pre diabetic", "conditions", "Prediabetes"), ("pre diabetics", "conditions", "Prediabetes"),
    ("hypertension", "conditions", "Hypertension"), ("high blood pressure", "conditions", "Hypertension"),
    ("cardiovascular disease", "conditions", "Cardiovascular disease"), ("cvds", "conditions", "Cardiovascular disease"),
    ("sarcopenia", "conditions", "Sarcopenia"), ("osteoporosis", "conditions", "Osteoporosis"), ("mediterranean diet", "conditions", "Mediterranean diet"),
    ("전당뇨", "conditions", "Prediabetes"), ("당뇨", "conditions", "Type 2 diabetes"), ("제2형 당뇨", "conditions", "Type 2 diabetes"),
    ("고혈압", "conditions", "Hypertension"), ("골다공증", "conditions", "Osteoporosis"), ("근감소증", "conditions", "Sarcopenia"),
    ("metformin", "medications", "Metformin"), ("mounjaro", "medications", "Mounjaro"), ("maunzaro", "medications", "Mounjaro"),
    ("tirzepatide", "medications", "Mounjaro"), ("aspirin", "medications", "Aspirin"),
    ("메트포민", "medications", "Metformin"), ("몬자로", "medications", "Mounjaro"), ("아스피린", "medications", "Aspirin"),
    ("longevity", "goals", "longevity"), ("weight_management", "goals", "weight_management"), ("weight management", "goals", "weight_management"),
    ("hypertension_management", "goals", "hypertension_management"),
    ("혈당 관리", "goals", "weight_management"), ("체중 관리", "goals", "weight_management"), ("장수", "goals", "longevity"),
    ("shoulder pain", "symptoms", "Shoulder Pain"), ("joint pain", "symptoms", "Joint Pain"), ("back pain", "symptoms", "Back Pain"),
    ("fatigue", "symptoms", "Fatigue"), ("bloating", "symptoms", "Bloating"), ("headache", "symptoms", "Headache"), ("headaches", "symptoms", "Headaches"),
    ("insomnia", "symptoms", "Insomnia"), ("anxiety", "symptoms", "Anxiety"), ("stress", "symptoms", "Stress"), ("inflammation", "symptoms", "Inflammation"),
    ("brain fog", "symptoms", "Brain Fog"), ("memory", "symptoms", "Memory"), ("dizziness", "symptoms", "Dizziness"),
    ("어깨 통증", "symptoms", "Shoulder pain"), ("관절 통증", "symptoms", "Joint pain"), ("요통", "symptoms", "Back pain"),
    ("피로", "symptoms", "Fatigue"), ("두통", "symptoms", "Headache"), ("불면증", "symptoms", "Insomnia"), ("스트레스", "symptoms", "Stress"),
]
#: (pattern, field, term) of what a text lets one suppose.
TOPICS = [
    (r"\b(?:blood sugar|glucose|glycem|insulin resist|a1c|hba1c|diabetic)\b", "conditions", "Type 2 diabetes"),
    (r"\b(?:heart|cardiac|cholesterol|ldl|hdl|triglyceride|atheroscler|artery|arteries)\b", "conditions", "Cardiovascular disease"),
    (r"\b(?:bone density|weak bones?|fragile bones?|fracture risk|calcium deficiency)\b", "conditions", "Osteoporosis"),
    (r"\b(?:muscle loss|muscle weakness|losing muscle|weak muscles?|muscle wasting)\b", "conditions", "Sarcopenia"),
    (r"\b(?:blood pressure|hypertensive|bp reading)\b", "conditions", "Hypertension"),
    (r"혈당", "conditions", "Type 2 diabetes"),
    (r"심장|콜레스테롤", "conditions", "Cardiovascular disease"),
    (r"뼈.*약|약한.*뼈", "conditions", "Osteoporosis"),
    (r"근력.*약|근육.*감소", "conditions", "Sarcopenia"),
    (r"\b(?:lose weight|weight loss|lose some weight|slim|diet)\b", "goals", "weight_management"),
    (r"\b(?:live longer|longevity|healthy aging|age well)\b", "goals", "longevity"),
    (r"\b(?:lower.*blood pressure|manage.*pressure)\b", "goals", "hypertension_management"),
    (r"체중.*감량|살.*빼|다이어트", "goals", "weight_management"),
]
QUESTIONS = {
    "age guessed": "We guessed you're around {} — is that right?",
    "age": "How old are you? (helps us tailor recommendations)",
    "condition inferred": "We inferred you may have {} — is that correct?",
    "conditions": "Is there a health condition you're managing or watching?",
    "gender": "What's your biological sex? (optional — improves nutritional advice)",
}
HINTS = {"age": "e.g. 45", "conditions": "e.g. Type 2 diabetes, Hypertension"}
GENDER_OPTIONS = ["female", "male", "prefer not to say"]

#: Phrase tables up to this length are searched by one automaton in each task, longer ones by a join.
MOST_PHRASES = 50_000
_FIELDS = ["conditions", "medications", "goals", "symptoms"]


def _java(pattern: str) -> str:
    """Borders, blanks and word characters of all scripts; a dot stops at line feeds only."""
    return f"(?Ud){pattern}"


def _first(pairs: list[tuple[Column, Column]]) -> Column:
    """The value of the first test that holds, else null."""
    out = F.when(*pairs[0])
    for test, value in pairs[1:]:
        out = out.when(test, value)
    return out


def age_from_text(text: Column) -> Column:
    """struct(age, fuzzy): the first exact pattern that gives 1 to 120, then years from 10 to 120, then rough ages in those bounds."""
    t = F.lower(text)
    number = lambda p: F.nullif(F.regexp_extract(t, _java(p), 1), F.lit("")).try_cast("int")
    within = lambda n, low: F.when(n.between(low, 120), n)
    exact = F.coalesce(*[within(number(p), 1) for p in AGE_PATTERNS], within(number(YEARS_PATTERN), 10))
    rough = F.coalesce(*[within(number(p) + shift, 10) for p, shift in DECADE_PATTERNS])
    return F.struct(F.coalesce(exact, rough).alias("age"), (exact.isNull() & rough.isNotNull()).alias("fuzzy"))


def gender_from_text(text: Column) -> Column:
    """struct(gender, fuzzy): the first word that the text holds, else, fuzzy, the first pronoun.

    A lone m or f counts, and so does the m of "I'm" after its apostrophe.
    """
    t = F.lower(text)
    said = _first([(t.rlike(_java(rf"\b{w}\b")) if w.isascii() else F.contains(text, F.lit(w)), F.lit(g)) for w, g in GENDER_WORDS])
    supposed = _first([(t.rlike(_java(p)), F.lit(g)) for p, g in GENDER_PRONOUNS])
    return F.struct(F.coalesce(said, supposed).alias("gender"), (said.isNull() & supposed.isNotNull()).alias("fuzzy"))


# ---- phrases ----


@lru_cache(maxsize=8)
def _automaton(phrases: tuple[tuple[str, bool], ...]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    places: dict[str, list[int]] = {}
    for i, (phrase, _) in enumerate(phrases):
        places.setdefault(phrase, []).append(i)
    for phrase, at in places.items():
        made.add_word(phrase, (len(phrase), at))
    made.make_automaton()
    return made


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def phrases_in(text: str | None, phrases: tuple[tuple[str, bool], ...]) -> list[int]:
    """Places of the phrases (phrase in lower case, as whole words) that a text holds, ascending."""
    if not text or not phrases:
        return []
    low, found = text.lower(), set()
    for end, (length, at) in _automaton(phrases).iter(low):
        begin = end - length + 1
        bounded = not ((begin and _in_word(low[begin - 1]) and _in_word(low[begin])) or (end + 1 < len(low) and _in_word(low[end]) and _in_word(low[end + 1])))
        found.update(i for i in at if bounded or not phrases[i][1])
    return sorted(found)


def _found(phrases: tuple[tuple[str, bool], ...]):
    @F.pandas_udf("array<int>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([phrases_in(t, phrases) for t in texts], dtype=object)

    return of


def terms_from_text(texts: DataFrame, phrases: DataFrame, most: int = MOST_PHRASES) -> DataFrame:
    """(id, kind, term) for each phrase (phrase, kind, term, perhaps whole) that a text (id, text) holds, letter case aside.

    A phrase stands for whole words unless `whole` is false.  A word is a run of letters, digits and underscores, and a phrase
    must match what is between its words.  Up to `most` phrases make one automaton, which passes over a text once.  More of them
    are joined by equality: to the runs of words of each length that phrases have, and for parts of words to the
    substrings of their lengths.  Null and empty texts and phrases give no row.
    """
    rows = phrases.select(F.lower("phrase").alias("phrase"), "kind", "term", F.coalesce(F.col("whole"), F.lit(True)).alias("whole") if "whole" in phrases.columns else F.lit(True).alias("whole"))
    rows = rows.where(F.col("phrase") != "").distinct()
    held = rows.limit(most + 1).collect()  # most + 1 rows at most
    if len(held) <= most:
        if not held:
            return texts.select("id", F.lit("").alias("kind"), F.lit("").alias("term")).limit(0)
        held.sort(key=lambda r: (r.phrase, r.whole))
        named = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.term).alias("term")) for r in held]) if len(held) <= 500 else None
        places = texts.select("id", F.explode(_found(tuple((r.phrase, r.whole) for r in held))("text")).alias("at"))
        if named is not None:
            return places.select("id", named[F.col("at")].alias("x")).select("id", "x.kind", "x.term").distinct()
        table = texts.sparkSession.createDataFrame([(i, r.kind, r.term) for i, r in enumerate(held)], "at int, kind string, term string")
        return places.join(F.broadcast(table), "at").select("id", "kind", "term").distinct()  # `most` rows at most
    word, rest = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    cut = lambda c: F.regexp_extract_all(c, F.lit(f"{word}+|{rest}"), F.lit(0))
    sized = rows.withColumn("n", F.when(F.col("whole"), F.size(cut(F.col("phrase")))).otherwise(F.length("phrase")))
    lengths = {w: sorted(r["n"] for r in sized.where(F.col("whole") == w).select("n").distinct().collect()) for w in (True, False)}
    low, pieces = F.lower("text"), []
    if lengths[True]:
        # A run may start or end inside a gap, as a phrase may; runs that start or end in a word hold all of it.
        runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.array(*map(F.lit, lengths[True])), lambda n: F.array_join(F.slice("w", i, n), ""))))
        pieces.append(texts.select("id", cut(low).alias("w")).where(F.size("w") > 0).select("id", F.explode(runs).alias("phrase"), F.lit(True).alias("whole")))
    if lengths[False]:
        parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.transform(F.array(*map(F.lit, lengths[False])), lambda n: F.col("t").substr(i, n))))
        pieces.append(texts.select("id", low.alias("t")).where(F.length("t") > 0).select("id", F.explode(parts).alias("phrase"), F.lit(False).alias("whole")))
    out = pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])
    return out.distinct().join(rows, ["phrase", "whole"]).select("id", "kind", "term").distinct()


# ---- contexts ----


def _filled(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def _stated(hits: Column, phrases: list[tuple[str, str, str]], field: str) -> Column:
    """Terms of a field among the places of found phrases, in the phrases' order."""
    of_field = [F.lit(t if f == field else None).cast("string") for _, f, t in phrases]
    return F.array_distinct(F.filter(F.transform(hits, lambda i: F.array(*of_field)[i]), lambda t: t.isNotNull()))


def terms_inferred(text: Column, field: str, stated: Column) -> Column:
    """Terms of a field that a topic of the text lets one suppose and that are not stated, in the order of the topics."""
    low = F.lower(text)
    some = [F.when(low.rlike(_java(p)), F.lit(t)) for p, f, t in TOPICS if f == field]
    return F.array_except(F.array_distinct(F.filter(F.array(*some), lambda t: t.isNotNull())), stated)


def follow_ups(age: Column, age_fuzzy: Column, gender: Column, conditions: Column, inferred: Column) -> Column:
    """Array of struct(field, question, type, value, hint, options): what to confirm or to ask after a text was read.

    A guessed age is to be confirmed and a missing one to be given; then each inferred condition is to be confirmed; without
    any condition and without a gender these are asked for.
    """
    none = F.lit(None).cast("string")

    def ask(field: str, kind: str, question: str, value: Column = none, options: Column | None = None) -> Column:
        before, _, after = QUESTIONS[question].partition("{}")
        said = F.concat(F.lit(before), value, F.lit(after)) if after or "{}" in QUESTIONS[question] else F.lit(before)
        hint = F.lit(HINTS[field]) if kind in ("number", "text") else none
        held = F.lit(None).cast("array<string>") if options is None else options
        return F.struct(F.lit(field).alias("field"), said.alias("question"), F.lit(kind).alias("type"), value.alias("value"), hint.alias("hint"), held.alias("options"))

    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    first = F.array_compact(F.array(F.when(age.isNull(), ask("age", "number", "age")).when(age_fuzzy, ask("age", "confirm", "age guessed", age.cast("string")))))
    sure = F.transform(empty(inferred), lambda c: ask("conditions", "confirm", "condition inferred", c))
    none_known = F.size(empty(conditions)) + F.size(empty(inferred)) == 0
    last = F.array_compact(F.array(F.when(none_known, ask("conditions", "text", "conditions")), F.when(gender.isNull(), ask("gender", "select", "gender", none, F.array(*map(F.lit, GENDER_OPTIONS))))))
    return F.concat(first, sure, last)


def context_from_text(texts: DataFrame, id_col: str = "id", text_col: str = "text", phrases: list[tuple[str, str, str]] = PHRASES) -> DataFrame:
    """id, age, gender, conditions, symptoms, medications, goals, inferred, follow_up of every row of texts.

    A field without a value is null.  inferred lists the fields that hold a guess, follow_up what to confirm or to ask.  A table of
    phrases of one's own takes the place of PHRASES; it is a list, so that it is small.
    """
    text = F.col(f"`{text_col}`")
    table = tuple((p.lower(), p.isascii()) for p, _, _ in phrases)
    blank = F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit("")) == ""
    rows = texts.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), blank.alias("blank"), _found(table)(text).alias("hits"))
    stated = {f: _stated(F.col("hits"), phrases, f) for f in _FIELDS}
    said = rows.select("id", "text", "blank", age_from_text(F.col("text")).alias("a"), gender_from_text(F.col("text")).alias("g"), *[c.alias(f) for f, c in stated.items()])
    more = said.withColumns({f"more_{f}": F.coalesce(terms_inferred(F.col("text"), f, F.col(f)), F.array().cast("array<string>")) for f in ("conditions", "goals")})
    guessed = [(F.col("a.fuzzy"), "age"), (F.col("g.fuzzy"), "gender"), (F.size("more_conditions") > 0, "conditions"), (F.size("more_goals") > 0, "goals")]
    inferred = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in guessed]))
    asked = follow_ups(F.col("a.age"), F.col("a.fuzzy"), F.col("g.gender"), F.col("conditions"), F.col("more_conditions"))
    return more.select(
        "id",
        F.col("a.age").alias("age"),
        F.col("g.gender").alias("gender"),
        _filled(F.concat("conditions", "more_conditions")).alias("conditions"),
        _filled(F.col("symptoms")).alias("symptoms"),
        _filled(F.col("medications")).alias("medications"),
        _filled(F.concat("goals", "more_goals")).alias("goals"),
        F.when(F.col("blank"), F.array().cast("array<string>")).otherwise(inferred).alias("inferred"),
        F.when(F.col("blank"), F.filter(asked, lambda q: F.lit(False))).otherwise(asked).alias("follow_up"),
    )
