"""Column functions over answer texts, choices and prompts. No Python worker runs; all work on streams as well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
UNPARSED_CHOICE = "Unknown"
UNPARSED_ANSWER = "(unparsed)"
NO_TRANSCRIPT = "[NO TRANSCRIPT]"
NO_FEATURES = "[FEATURES UNAVAILABLE]"
HEALTHY_LABEL = "No potential disease detected"
NON_ENGLISH_SHARE = 0.2
PAD_SECONDS = 0.5
CJK_CLASS = "[\\u3000-\\u303F\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uAC00-\\uD7AF\\uFF00-\\uFFEF]"
BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
WHITE = "\t\n \x1f\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000" + BREAKS
#: Bytes that white space begins and ends with (and other characters as well).
WHITE_FIRST, WHITE_LAST = (bytes({c.encode()[k] for c in WHITE}) for k in (0, -1))
QUOTES = "\"'`.*"
EXPLICIT = r"(?U)(?i:final answer|correct (?:answer|choice|option)|answer)\s*(?i:is)?\s*:?\s*[\(\[]?\*{0,2}([A-Z])\b(?![\w'])"
ALONE = r"^[\(\[]?\*{0,2}([A-Z])\*{0,2}[\.\):\]]?$"
PREFIX = r"(?U)^[\(\[]?\*{0,2}([A-Z])\*{0,2}[\.\):\]][\s\x1c-\x1f]+[^\s\x1c-\x1f]"
WITH_TEXT = r"(?U)^[\(\[]?\*{0,2}([A-Z])\*{0,2}[\.\):\]][\s\x1c-\x1f]*(.+)$"
#: What ALONE, PREFIX and WITH_TEXT begin with; a line's first bytes tell.
HEAD = r"^[\(\[]?\*{0,2}[A-Z]\*{0,2}(?:[\.\):\]]|$)"
#: Bytes from which a text counts as long: whether it may be a choice's text is told from its beginning first.
LONG = 256
RECORDING = r"(?i)recorded at the patient'?s\s+([a-z][a-z \-]*?)\s*,\s*with the acquisition mode being\s+(single channel|multichannel)"


def falsy_or(*texts: Column) -> Column:
    """The first text that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def strip(text: Column) -> Column:
    """The text without white space at its ends, Unicode's and the separators 1C to 1F included."""
    end = lambda at, some: F.contains(F.lit(some), F.substring(text.cast("binary"), at, 1))
    return F.when(end(1, WHITE_FIRST) | end(-1, WHITE_LAST), F.btrim(text, F.lit(WHITE))).otherwise(text)


def _begin(text: Column, size: int) -> Column:
    """The first bytes of a text; what is beyond isn't looked at. Its last character may be cut."""
    return F.substring(text.cast("binary"), 1, size).cast("string")


def canonical(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def file_stem(path: Column) -> Column:
    """A path's last component without its last suffix."""
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def item_key(meta_id: Column, sample_id: Column) -> Column:
    """The metadata's id if there is one, else the sample's file stem."""
    return F.when(F.coalesce(meta_id, F.lit("")) != "", meta_id).otherwise(file_stem(sample_id))


def parse_recording_metadata(instruction: Column) -> Column:
    """``struct(location, mode)``, both lower-case; null if the instruction doesn't say them."""
    said = F.struct(F.lower(F.trim(F.regexp_extract(instruction, RECORDING, 1))).alias("location"), F.lower(F.regexp_extract(instruction, RECORDING, 2)).alias("mode"))
    return F.when(instruction.rlike(RECORDING), said)


def normalize_choices(raw: Column) -> Column:
    """A choices cell given as text (a JSON or Python list) as ``array<string>``; null where it is none, empty or over 26 long."""
    parsed = F.from_json(raw, "array<string>", {"allowSingleQuotes": "true"})
    return F.when(F.trim(raw).startswith("[") & F.size(parsed).between(1, 26), parsed)


def letter_for_index(index: Column) -> Column:
    return F.chr(F.lit(65) + index)


def index_for_letter(letter: Column) -> Column:
    return F.ascii(letter) - 65


def format_lettered_choices(choices: Column) -> Column:
    return F.array_join(F.transform(choices, lambda c, i: F.concat(letter_for_index(i), F.lit(". "), c)), "\n")


def canonical_choices(choices: Column) -> Column:
    return F.transform(choices, canonical)


def _sought(text: Column) -> Column:
    """A text as it is compared with canonical choices: quotes, backticks, dots, asterisks, case and spacing aside."""
    return canonical(F.btrim(strip(text), F.lit(QUOTES)))


def _only(sought: Column, canon: Column) -> Column:
    """Letter of the one canonical choice that equals ``sought``; null where none or several do."""
    at = F.array_position(canon, sought).cast("int")
    once = (at > 0) & (F.size(F.array_remove(canon, sought)) == F.size(canon) - 1)
    return F.when((sought != "") & once, letter_for_index(at - 1))


def match_choice_text(text: Column, choices: Column) -> Column:
    """Letter of the one choice that equals the text, quotes, backticks, dots, asterisks, case and spacing aside."""
    return _only(_sought(text), canonical_choices(choices))


def answer_to_letter(answer: Column, choices: Column) -> Column:
    """Letter of the first choice that equals the gold answer; null where none does."""
    at = F.array_position(canonical_choices(choices), canonical(answer)).cast("int")
    return F.when(at > 0, letter_for_index(at - 1))


def strip_thinking(text: Column) -> Column:
    """The text without closed reasoning blocks, and without an unclosed one and all that follows."""
    return strip(_unthought(text))


def _unthought(text: Column) -> Column:
    kept = text
    for pattern in (r"(?is)<think>.*?</think>", r"(?is)<\|channel>thought.*?<channel\|>", r"(?is)<think>.*\z"):
        kept = F.regexp_replace(kept, pattern, "")
    return F.when(text.contains("<"), kept).otherwise(text)


def _valid(letter: Column, choices: Column) -> Column:
    return F.when((letter != "") & (F.ascii(letter) - 65 < F.size(choices)), letter)


def _headed(line: Column) -> Column:
    return _begin(line, 16).rlike(HEAD)


def _leading(line: Column, choices: Column) -> Column:
    return F.when(_headed(line), F.coalesce(*[_valid(F.regexp_extract(line, p, 1), choices) for p in (ALONE, PREFIX)]))


def _says(text: Column, words: list[str]) -> Column:
    """Whether the text has one of the words, case aside."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def with_letter(rows: DataFrame, text: str = "text", choices: str = "choices", out: str = "letter") -> DataFrame:
    """``rows`` with ``out``: the chosen letter, or null where nothing is unambiguous.

    In this order: the last explicit statement with a valid letter; the whole answer, then its first line, equal to one
    choice's text; a letter on the first, then on the last line; the one letter that all answer-shaped lines name. Of
    an answer in tags only the inside counts.

    Projections only, so streams work as well. Each step is a column of its own: an answer is cleaned and a row's
    choices are made canonical once, and what an earlier stage decides never reaches a later one. A long text is made
    canonical as a whole only if its beginning is no longer than the longest choice then: else it is none of them.
    """
    canon, shown, flat, first, last = (F.col(f"_{c}") for c in ("canon", "shown", "flat", "first", "last"))
    options, said = F.col(choices), F.col("_said")
    inside = F.when(shown.rlike("(?i)<answer>"), F.regexp_extract(shown, r"(?is)<answer>(.*?)(?:</answer>|$)", 1)).otherwise(shown)
    valid = F.filter(F.regexp_extract_all(shown, F.lit(EXPLICIT), 1), lambda x: F.ascii(x) - 65 < F.size(options))

    def named(line: Column) -> Column:
        """The letter that a line names alone or before the text of just that choice."""
        letter = _valid(F.regexp_extract(line, WITH_TEXT, 1), options)
        return F.coalesce(_valid(F.regexp_extract(line, ALONE, 1), options), F.when(_only(_sought(F.regexp_extract(line, WITH_TEXT, 2)), canon) == letter, letter))

    lines = F.filter(F.transform(F.split(flat, "\n"), strip), _headed)
    names = F.array_distinct(F.filter(F.transform(lines, named), lambda x: x.isNotNull()))
    longest = F.array_max(F.transform(canon, F.length))
    head = lambda t: F.when(undecided & (F.octet_length(t) > LONG), _sought(_begin(t, LONG)))
    fits = F.coalesce(F.length("_head") <= longest + 4, F.lit(True))  # a cut character may count as several
    undecided = said.isNull()
    steps = rows.withColumn("_shown", _unthought(F.col(text))).withColumn("_shown", strip(shown))
    steps = steps.withColumn("_shown", F.when(shown.contains("<"), inside).otherwise(shown)).withColumn("_shown", strip(shown))
    steps = steps.withColumn("_said", F.when(_says(shown, ["answer", "choice", "option"]), valid))
    steps = steps.withColumn("_said", F.get(said, F.size(said) - 1))
    steps = steps.withColumns({"_canon": F.when(undecided, canonical_choices(options)), "_flat": F.when(undecided, F.when(shown.rlike(f"[{BREAKS[:-2]}]") | F.contains(shown, F.lit(BREAKS[-2])) | F.contains(shown, F.lit(BREAKS[-1])), F.translate(shown, BREAKS, "\n" * len(BREAKS))).otherwise(shown)), "_head": head(shown)})
    steps = steps.withColumns({"_lines": F.contains(flat, F.lit("\n")), "_whole": _sought(F.when(undecided & fits, shown))})
    steps = steps.withColumn("_said", F.coalesce(said, _only(F.col("_whole"), canon)))
    steps = steps.withColumns({"_first": F.when(F.col("_lines") & undecided, F.substring_index(flat, "\n", 1)).otherwise(flat), "_last": F.when(F.col("_lines") & undecided, F.substring_index(flat, "\n", -1))})
    steps = steps.withColumns({"_first": strip(first), "_last": strip(last)})
    steps = steps.withColumn("_head", F.when(F.col("_lines"), head(first)))
    steps = steps.withColumn("_whole", F.when(F.col("_lines") & undecided & fits, _sought(first)))
    steps = steps.withColumn("_said", F.coalesce(said, _only(F.col("_whole"), canon), _leading(first, options), F.when(F.col("_lines"), _leading(last, options))))
    steps = steps.withColumn("_names", F.when(undecided, names))
    letter = F.coalesce(said, F.when(F.size("_names") == 1, F.get("_names", F.lit(0))))
    known = (F.coalesce(F.col(text), F.lit("")) != "") & (F.size(options) > 0)
    return steps.withColumn(out, F.when(known, letter)).drop("_shown", "_canon", "_said", "_flat", "_head", "_lines", "_whole", "_first", "_last", "_names")


def cjk_share(text: Column) -> Column:
    cjk = F.regexp_count(text, F.lit(CJK_CLASS))
    letters = cjk + F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(letters > 0, cjk / letters).otherwise(0.0)


def contains_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK_CLASS), F.lit(False))


def is_non_english(text: Column) -> Column:
    plain = F.octet_length(text) == F.length(text)  # ASCII alone
    return F.coalesce(F.when(plain, F.lit(False)).otherwise(cjk_share(text) >= NON_ENGLISH_SHARE), F.lit(False))


def answer_text(letter: Column, choices: Column) -> Column:
    return F.coalesce(F.get(choices, index_for_letter(letter)), F.lit(UNPARSED_ANSWER))


def is_correct(parsed: Column, gold: Column, choices: Column, legacy_score: Column) -> Column:
    """Parsed letter equal to gold (two nulls are equal) where there are choices, else a judge's score of 10."""
    return F.when(F.coalesce(F.size(choices), F.lit(0)) > 0, parsed.eqNullSafe(gold)).otherwise(F.coalesce(legacy_score == 10, F.lit(False)))


def parse_judgement(raw: Column) -> Column:
    """A judge's JSON with scores in range, else the fallback (0, 0, 1, "Unknown")."""
    kind = "struct<reasoning:string,acoustic_accuracy:int,diagnostic_accuracy:int,hallucination_penalty:int,extracted_class:string>"
    got = F.from_json(raw, kind)
    ok = got["acoustic_accuracy"].between(0, 10) & got["diagnostic_accuracy"].between(0, 10) & got["hallucination_penalty"].between(0, 1) & got["extracted_class"].isNotNull()
    back = F.struct(F.lit("").alias("reasoning"), F.lit(0).alias("acoustic_accuracy"), F.lit(0).alias("diagnostic_accuracy"), F.lit(1).alias("hallucination_penalty"), F.lit(UNPARSED_CHOICE).alias("extracted_class")).cast(kind)
    return F.when(F.coalesce(ok, F.lit(False)), got).otherwise(back)


def normalize_label(label: Column) -> Column:
    return F.when(label == HEALTHY_LABEL, "Healthy").when(F.coalesce(label, F.lit("")).isin("", "None"), "Unknown").otherwise(label)


def parse_time_span(text: Column, duration: Column) -> Column:
    """``struct(start, end, crop_start, crop_end)`` of the first flat JSON object with start < end inside the clip, else null."""
    number = lambda m, k: F.try_element_at(m, F.lit(k)).try_cast("double")
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(x, duration))
    spans = F.transform(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), 0), lambda o: F.from_json(o, "map<string,string>"))
    spans = F.transform(spans, lambda m: F.struct(clamp(number(m, "start")).alias("start"), clamp(number(m, "end")).alias("end")))
    usable = F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & (s["start"] < s["end"]))
    crop = F.transform(usable, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.greatest(F.lit(0.0), s["start"] - PAD_SECONDS).alias("crop_start"), F.least(duration, s["end"] + PAD_SECONDS).alias("crop_end")))
    return F.get(crop, F.lit(0))


def position_in_cycle(t: Column, start: Column, end: Column) -> Column:
    share = (t - start) / (end - start)
    return F.when(end - start <= 0, "middle").when(share < 1 / 3, "early").when(share < 2 / 3, "middle").otherwise("late")


def chunk_bounds(samples: Column, rate: Column, length_s: float = 5.0, most: int = 4) -> Column:
    """Equal chunks that cover the whole clip, as an array of ``struct(start, end)`` in samples."""
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(samples / rate / length_s))).cast("long")
    at = lambda i: F.floor(samples * i / n).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(at(i).alias("start"), at(i + 1).alias("end")))


def window_bounds(samples: Column, rate: Column, length_s: float = 5.0, overlap: float = 0.5) -> Column:
    """Windows with overlap that lie wholly inside the clip; a short clip is one window."""
    samples, window = samples.cast("long"), (rate * length_s).cast("long")
    hop = F.greatest(F.lit(1).cast("long"), (window * (1 - overlap)).cast("long"))
    many = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(samples - window, F.lit(0).cast("long")), hop), lambda s: F.struct(s.alias("start"), F.least(s + window, samples).alias("end")))
    return F.when(samples <= window, F.array(F.struct(F.lit(0).cast("long").alias("start"), samples.alias("end")))).otherwise(many)


def question_block(question: Column, choices: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nChoices:\n"), format_lettered_choices(choices))


def render_instruction(turns: Column, context: Column, question: Column, choices: Column, two_pass: Column) -> Column:
    """Prompt turns with the question block on the last one and, for two passes, the question on the first one.

    ``context``: parts already joined, null or empty where there are none.
    """
    body = F.concat_ws("\n\n", F.nullif(context, F.lit("")), question_block(question, choices))
    last = F.size(turns) - 1
    with_question = F.transform(turns, lambda t, i: F.when(two_pass & (i == 0), F.concat(t, F.lit("\n\nQuestion: "), question)).otherwise(t))
    return F.transform(with_question, lambda t, i: F.when(i == last, F.concat(t, F.lit("\n\n"), body)).otherwise(t))


def judge_user_text(instruction: Column, final: Column, generated: Column) -> Column:
    return F.concat(F.lit("--- PROMPT ---\n"), instruction, F.lit("\n\n--- MODEL ANSWER ---\n"), falsy_or(final, generated), F.lit("\n"))


def shot_answer(letter: Column, reasoning: Column, tagged: Column) -> Column:
    """A demonstration's answer: the bare letter, or reasoning and letter in tags."""
    why = F.coalesce(reasoning, F.concat(F.lit("The correct choice is "), letter, F.lit(".")))
    return F.when(tagged, F.concat(F.lit("<analysis>\n"), why, F.lit("\n</analysis>\n<answer>\n"), letter, F.lit("\n</answer>"))).otherwise(letter)
