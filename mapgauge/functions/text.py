"""Parsers of free-text answers, as Column -> Column; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The label sets.
DIRECTIONS = ("north", "south", "east", "west", "north-east", "north-west", "south-east", "south-west")
PREDICATES = ("contains", "crosses", "disjoint", "equals", "overlaps", "touches", "within")
#: Words that stand for a predicate; the order decides which is taken.
SYNONYMS = {
    "contains": ["contains", "is home to", "contains/has", "has", "includes", "include", "home to"],
    "within": ["is within", "within", "inside", "in"],
    "touches": ["touches", "adjacent", "borders", "adjacent to", "bordered"],
    "crosses": ["crosses", "straddles", "spans", "crossed"],
    "disjoint": ["disjoint", "between", "separate", "separated"],
    "overlaps": ["overlaps", "overlap", "extends into", "partly"],
}
#: White space inside numbers beside the ASCII kind, which is all that \s means to the JVM; and what a number is.
WIDE = "\u00a0\u202f"
NUMBER = rf"[0-9][0-9,\s{WIDE}]*\.?[0-9]*"


#: All that counts as white space at the ends of an answer.
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space of any kind at both ends; F.trim takes spaces only."""
    return F.btrim(_col(c), F.lit(SPACE))


# --- compass directions ---------------------------------------------------------------------------------------


def _hyphenate(c: Column, spaced: bool) -> Column:
    for a in ("north", "south"):
        for b in ("east", "west"):
            c = F.replace(c, F.lit(a + b), F.lit(f"{a}-{b}"))
            if spaced:
                c = F.replace(c, F.lit(f"{a} {b}"), F.lit(f"{a}-{b}"))
    return c


def direction_v1(c, prediction: bool = False) -> Column:
    """Lower, trim, hyphenate joined words; a prediction loses `.` and `,` first. Null stays null."""
    c = _col(c)
    if prediction:
        c = F.replace(F.replace(strip(c), F.lit("."), F.lit("")), F.lit(","), F.lit(""))
    return _hyphenate(strip(F.lower(c)), False)


def direction(c) -> Column:
    """Like v1 for spaced words too, then without `.` and `,`; null becomes ''."""
    c = _hyphenate(strip(F.lower(F.coalesce(_col(c), F.lit("")))), True)
    return strip(F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("")))


def is_direction(c) -> Column:
    return _col(c).isin(*DIRECTIONS)


# --- coordinates and distances --------------------------------------------------------------------------------


def latlon(c) -> Column:
    """S3: struct(lat, lon), both null where nothing parses: the first two decimals if they are in range, else a labelled pair."""
    c = _col(c)
    # fixed values: the patterns of a decimal and of a labelled pair
    nums = F.regexp_extract_all(c, F.lit(r"(-?[0-9]+\.[0-9]+)"), F.lit(1))
    a, b = (F.get(nums, F.lit(i)).try_cast("double") for i in (0, 1))
    ok = F.coalesce(a.between(-90, 90) & b.between(-180, 180), F.lit(False))
    low = F.lower(F.replace(c, F.lit("\n"), F.lit(" ")))
    pair = r"lat(?:itude)?[:=\s]+(-?[0-9]+\.[0-9]+).{0,40}lon(?:gitude)?[:=\s]+(-?[0-9]+\.[0-9]+)"
    x, y = (F.regexp_extract(low, pair, i).try_cast("double") for i in (1, 2))
    return F.struct(F.when(ok, a).otherwise(x).alias("lat"), F.when(ok, b).otherwise(y).alias("lon"))


def clean_number(c) -> Column:
    return F.regexp_replace(_col(c), rf"[,\s{WIDE}]", "")


def distance(c) -> Column:
    """struct(value, raw, cleaned, strategy): the first number before km or kilometers, else the first of 50 or more, else the last."""
    c = _col(c)
    unit = F.nullif(F.regexp_extract(c, rf"(?i)({NUMBER})[\s{WIDE}]*(?:km|kilometers)", 1), F.lit(""))
    every = F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1))
    far = F.get(F.filter(every, lambda x: F.coalesce(clean_number(x).try_cast("double"), F.lit(-1.0)) >= 50), F.lit(0))
    last = F.get(every, F.size(every) - 1)
    raw = F.coalesce(unit, far, last)
    strategy = F.when(unit.isNotNull(), "unit").when(far.isNotNull(), "first>=50").when(last.isNotNull(), "fallback_last")
    return F.struct(clean_number(raw).try_cast("double").alias("value"), raw.alias("raw"), clean_number(raw).alias("cleaned"), strategy.alias("strategy"))


def distance_or(c, predicted) -> Column:
    """struct(value, strategy): distance(), but the given prediction where the text is empty or blank."""
    found = distance(c)
    blank = F.coalesce(strip(_col(c)) == "", F.lit(True))
    use = blank & _col(predicted).isNotNull()
    return F.struct(F.when(use, _col(predicted).cast("double")).otherwise(found["value"]).alias("value"), F.when(use, "fallback_predicted_dis").otherwise(found["strategy"]).alias("strategy"))


def predicted_value(output, prompt) -> Column:
    """The number after the prompt, without thousands commas and trailing dots; null if it is none."""
    rest = F.rtrim(strip(F.replace(_col(output), _col(prompt), F.lit(""))), F.lit("."))
    return F.coalesce(rest.try_cast("double"), F.replace(rest, F.lit(","), F.lit("")).try_cast("double"))


# --- short answers --------------------------------------------------------------------------------------------


def short_answer(c) -> Column:
    """Trimmed, lower, without trailing punctuation and one leading article."""
    c = F.rtrim(F.lower(strip(_col(c))), F.lit(".,;:!?"))
    return strip(F.regexp_replace(c, r"^(the|a|an) ", ""))


# --- topological predicates -----------------------------------------------------------------------------------


def _first(parts: Column, test) -> Column:
    return F.get(F.filter(parts, test), F.lit(0))


def predicate(c, last_answer: bool = False) -> Column:
    """The first valid predicate in the first bracket after `answer:` (the first such section, or the last), else the first
    predicate by name that the text holds anywhere, else 'invalid'. The order of that search is fixed by name."""
    c = F.lower(strip(_col(c)))
    has = F.contains(c, F.lit("answer:"))
    sections = F.split(c, "answer:")
    after = F.get(sections, F.size(sections) - 1) if last_answer else F.get(sections, F.lit(1))
    bracket = F.when(F.contains(after, F.lit("[")) & F.contains(after, F.lit("]")), F.get(F.split(F.get(F.split(after, r"\["), F.lit(1)), r"\]"), F.lit(0)))
    parts = F.transform(F.split(bracket, "/"), lambda p: F.when(F.contains(p, F.lit("is within")), "within").otherwise(strip(p)))
    found = F.when(has, _first(parts, lambda p: p.isin(*PREDICATES)))
    anywhere = F.coalesce(*[F.when(F.contains(c, F.lit(p)), p) for p in PREDICATES])
    return F.coalesce(found, anywhere, F.when(c.isNotNull(), "invalid"))


def _canon(p: Column) -> Column:
    return F.coalesce(*[F.when(p.isin(*words), name) for name, words in SYNONYMS.items()])


def _anywhere(c: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(c, F.lit(w)), name) for name, words in SYNONYMS.items() for w in words])


def canonical(c, strict: bool = True) -> Column:
    """The predicate a bracket or the text means. strict takes an exact label first, so `disjoint` is not found as `in`
    and `equals` is found at all; strict=False keeps the order of the published results. Null stays null."""
    low = F.lower(_col(c))
    inside = F.nullif(F.regexp_extract(low, r"^[^\[]*\[([^\]]+)\]", 1), F.lit(""))
    parts = F.split(inside, "/")
    named = F.filter(F.transform(parts, lambda p: _canon(strip(p))), lambda p: p.isNotNull())
    bracket = F.coalesce(F.get(named, F.lit(0)), strip(F.get(parts, F.lit(0))))
    exact = F.when(strip(low).isin(*PREDICATES), strip(low)) if strict else F.lit(None).cast("string")
    return F.when(inside.isNotNull(), bracket).otherwise(F.coalesce(exact, _anywhere(low)))


def canonical_all(c) -> Column:
    """All predicates of the first bracket, each made canonical, joined by '/'; without one, the first synonym found."""
    c = _col(c)
    inside = F.nullif(F.regexp_extract(c, r"\[([^\]]+)\]", 1), F.lit(""))
    parts = F.filter(F.transform(F.split(inside, "/"), lambda p: F.lower(strip(p))), lambda p: p != "")
    mapped = F.transform(parts, lambda p: F.coalesce(_canon(p), p))
    return F.when(inside.isNotNull(), F.nullif(F.array_join(mapped, "/"), F.lit(""))).otherwise(_anywhere(F.lower(c)))


def names_gold(c, gold) -> Column:
    """Whether the gold predicate is among canonical_all()."""
    return F.coalesce(F.array_contains(F.split(canonical_all(c), "/"), _col(gold)), F.lit(False))


# --- places, prompts, keys ------------------------------------------------------------------------------------


def clean_name(c) -> Column:
    """The part before the first comma, trimmed, lower."""
    return F.lower(strip(F.substring_index(_col(c), ",", 1)))


def generated_place(c, prefix=None) -> Column:
    """The fourth paragraph, without a given prefix."""
    block = F.get(F.split(_col(c), "\n\n"), F.lit(3))
    if prefix is None:
        return block
    p = _col(prefix)
    return F.when(F.startswith(block, p), F.substring(block, F.length(p) + 1, F.length(block))).otherwise(block)


def city_b(c) -> Column:
    """Lower, runs of other than word characters become one space, spaces become ', '."""
    return F.replace(strip(F.regexp_replace(F.lower(_col(c)), r"[^0-9A-Za-z_]+", " ")), F.lit(" "), F.lit(", "))


def snippet(c, n: int = 180) -> Column:
    """One line, cut after n characters."""
    c = F.replace(_col(c), F.lit("\n"), F.lit(" "))
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def file_phase(c) -> tuple[Column, Column]:
    """(phase, shot) of a file name gen_dis_<phase>_<shot>.json; nulls for any other."""
    pattern = r"^gen_dis_(p[0-9]+)_(3-shot|zero-shot)\.json$"
    return tuple(F.nullif(F.regexp_extract(_col(c), pattern, i), F.lit("")) for i in (1, 2))


#: The relation words of the sentence templates.
RELATIONS = {"near": "is near", "and": "and", "far": "is far from", "close": "is close to"}


def sentence_template(p_type: str, shots: bool = False) -> str:
    """The template of a relation: a sentence to go on with, after three whole ones if shots."""
    said = RELATIONS[p_type]
    head = "".join(f"{{city_{a}}} {said} {{city_{b}}}.\n\n" for a, b in ("ab", "cd", "ef")) if shots else ""
    return head + f"{{city}} {said}" + ("" if shots and p_type == "and" else " ")


def fill(template: str, **slots) -> Column:
    """A template with its {slots} filled by columns; a null slot makes the prompt null."""
    import string

    parts = []
    for plain, name, _, _ in string.Formatter().parse(template):
        parts += [F.lit(plain)] * bool(plain) + ([_col(slots[name]).cast("string")] if name else [])
    return F.concat(*parts) if parts else F.lit("")


def sentence_prompt(city, p_type: str, state: bool = True, exemplars=None) -> Column:
    """A sentence that asks for a place near, far from, close to or together with a city. exemplars: six columns of places, by
    which the form of three shots is filled. Without state, names lose what follows their first comma."""
    name = lambda c: _col(c) if state else F.substring_index(_col(c), ",", 1)
    slots = {} if exemplars is None else {f"city_{k}": name(c) for k, c in zip("abcdef", exemplars, strict=True)}
    return fill(sentence_template(p_type, exemplars is not None), city=name(city), **slots)


def _pair(p_type: str, a_name, b_name, a_lat, a_lon, b_lat, b_lon) -> Column:
    """Both places, with coordinates to four digits in types p2 and p4."""
    at = lambda x, y: F.format_string(" (%.4f, %.4f)", _col(x).cast("double"), _col(y).cast("double"))
    a, b = _col(a_name), _col(b_name)
    if p_type in ("p2", "p4"):
        a, b = F.concat(a, at(a_lat, a_lon)), F.concat(b, at(b_lat, b_lon))
    return F.concat(a, F.lit(" and "), b)


def distance_prompt(p_type: str, a_name, b_name, a_lat=None, a_lon=None, b_lat=None, b_lon=None, exemplars=None) -> Column:
    """p1 names and p2 names with coordinates ask for the number only, p3 names and p4 names with coordinates for an explanation.
    exemplars: an array of lines made by distance_exemplar()."""
    # fixed values: what is asked for
    ask = {
        "p1": "Answer exactly with the number only.",
        "p2": "Answer exactly with the number only.",
        "p3": "Explain your reasoning and how the distance is found.",
        "p4": "Explain your reasoning and how the distance is found using these coordinates.",
    }[p_type]
    core = F.concat(F.lit("Question: What is the distance in kilometers between "), _pair(p_type, a_name, b_name, a_lat, a_lon, b_lat, b_lon), F.lit(f"? {ask}\nAnswer:"))
    if exemplars is None:
        return core
    return F.concat(F.lit("Here are some examples:\n\n"), F.array_join(_col(exemplars), ""), F.lit("\nNow fulfill the following:\n"), core)


def distance_exemplar(p_type: str, a_name, b_name, distance, a_lat=None, a_lon=None, b_lat=None, b_lon=None) -> Column:
    """A solved pair, as the line of its type; distance as text."""
    # fixed values: how an answer is worded
    before, after = {
        "p1": ("", ""),
        "p2": ("", ""),
        "p3": ("The distance is approximately ", " km. This is calculated using spatial geometry."),
        "p4": ("Using the Haversine formula on these coordinates, the distance is ", " km."),
    }[p_type]
    return F.concat(F.lit("Question: Distance between "), _pair(p_type, a_name, b_name, a_lat, a_lon, b_lat, b_lon), F.lit(f"? Answer: {before}"), _col(distance).cast("string"), F.lit(f"{after}\n"))


def messages(system, question, shots=None) -> Column:
    """Array of (role, content): the system text, shots as pairs of (question, answer), the question."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), _col(c).alias("content"))
    head, tail = F.array(one("system", system)), F.array(one("user", question))
    if shots is None:
        return F.concat(head, tail)
    pairs = F.flatten(F.transform(shots, lambda s: F.array(one("user", s["question"]), one("assistant", s["answer"]))))
    return F.concat(head, pairs, tail)


#: The system text of the topological task.
TOPOLOGY_SYSTEM = "You are an expert in topological spatial reasoning."


def topology_prompt(sentence, subject, obj, relation=None, exemplars=None) -> Column:
    """The chat row that asks for the relation between two places of a sentence, and with `relation` answers it (a row to learn
    from). exemplars: an array of topology_exemplar(), set before the sentence; none and an empty one are the same."""
    user = F.concat(F.lit("Sentence: "), _col(sentence), F.lit("\nSubject: "), _col(subject), F.lit("\nObject: "), _col(obj))
    if exemplars is not None:
        e = _col(exemplars)
        block = F.concat(F.lit("\n\n--- EXAMPLES ---\n"), F.array_join(e, ""), F.lit("--- END EXAMPLES ---\n\n"))
        user = F.concat(F.when(F.size(e) > 0, block).otherwise(F.lit("")), user)
    head = F.concat(F.lit(f"<|start|>system\n{TOPOLOGY_SYSTEM}<|end|>\n<|start|>user\n"), user, F.lit("<|end|>\n<|start|>assistant\n"))
    return head if relation is None else F.concat(head, _col(relation), F.lit("<|end|>"))


def topology_exemplar(relation_text, subject_type, object_type, truth) -> Column:
    """A solved case."""
    r, a, b = map(_col, (relation_text, subject_type, object_type))
    asked = F.concat(F.lit("\nUser query: given the sentence: A "), r, F.lit(" B and A is "), a, F.lit(", B is "), b, F.lit(".\n"))
    why = F.concat(F.lit("Analysis: Based on the spatial context of '"), r, F.lit("' between a "), a, F.lit(" and a "), b, F.lit(", the standard topological relation matches.\n"))
    return F.concat(asked, why, F.lit("Answer: A ["), _col(truth), F.lit("] B\n"))


def composite_key(*parts, sep: str = "/") -> Column:
    """Joined keys; null if any part is null."""
    cols = []
    for i, p in enumerate(parts):
        cols += [F.lit(sep)] * (i > 0) + [_col(p)]
    return F.concat(*cols)


def key_part(c, i: int, sep: str = "/") -> Column:
    """Part i, from 0, of a joined key; null where it has no such part."""
    return F.get(F.split(_col(c), "\\Q" + sep + "\\E", -1), F.lit(i))


def run_stamp() -> dict[str, Column]:
    """When a row was made, in ISO form, and an id of its own. Not the same at each run, so kept out of comparisons."""
    return {"created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "request_id": F.replace(F.uuid(), F.lit("-"), F.lit(""))}
