"""Column functions that clean, tokenise and stem text. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]{2,}"
PUNCTUATION = r"[!-/:-@\[-`{-~]+"
SENTENCE_END = r"(?<=[.!?])\s+"

# What the line scrubber deletes, and what it turns into blanks.
SCRUB_ENTITIES = "(&gt|&#xD|&quot)"
SCRUB_DELETE = "!\"#$%&'()+,-:;<=>?@[\\]^`{|}~"
SCRUB_BLANK = "/*"


def tokenize(text: Column, flavour: str = "words", min_len: int = 2) -> Column:
    """Word tokens of a text.

    ``words``: runs of letters, digits and ``_`` in lower case; ``split``: pieces between blanks;
    ``marks``: words and punctuation marks as tokens of their own.
    """
    if flavour == "words":
        return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{%d,}" % min_len), F.lit(0))
    if flavour == "split":
        return F.filter(F.split(text, r"\s+"), lambda w: F.length(w) >= min_len)
    if flavour == "marks":
        return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))
    raise ValueError(f"unknown flavour {flavour}")


def normalize_text(text: Column, max_chars: int | None = None) -> Column:
    """Newlines and runs of non-ASCII to one blank, lower case, optionally cut."""
    flat = F.lower(F.regexp_replace(F.regexp_replace(text, "\n", " "), r"[^\x00-\x7F]+", " "))
    return flat if max_chars is None else F.substring(flat, 1, max_chars)


def scrub_markup_lines(text: Column, joiner: str = "") -> Column:
    """Drop lines that start with ``<``; clean the others of entities and most punctuation."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.ltrim(x)), lambda x: ~x.startswith("<"))

    def clean(line):
        line = F.regexp_replace(line, SCRUB_ENTITIES, "")
        line = F.translate(line, SCRUB_BLANK, " " * len(SCRUB_BLANK))
        return F.translate(line, SCRUB_DELETE, "")

    return F.array_join(F.transform(lines, clean), joiner)


def extract_tags(text: Column) -> Column:
    """All ``<tag>`` groups of a string."""
    return F.regexp_extract_all(text, F.lit("<[^>]+>"), F.lit(0))


def html_to_text(html: Column) -> Column:
    """Visible text of a page."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_vote_suffix(text: Column) -> Column:
    return F.regexp_replace(text, " ([0-9]+) votes$", "")


def remove_words(tokens: Column, words: Sequence[str]) -> Column:
    """Drop listed words. For lists of table size use an anti join on exploded terms instead."""
    drop = F.array(*[F.lit(w) for w in words])
    return F.filter(tokens, lambda t: ~F.array_contains(drop, t))


def keep_letter_terms(tokens: Column, stop_words: Sequence[str] = ()) -> Column:
    """Letter-only tokens of three letters or more that are no stop words, in lower case."""
    kept = F.filter(tokens, lambda t: t.rlike(r"^\p{L}{3,}$"))
    return F.transform(remove_words(kept, stop_words) if stop_words else kept, F.lower)


def keep_alnum_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(r"[a-zA-Z0-9\-\\/]"))


def clean_corpus(
    text: Column, stop_words: Sequence[str] = (),
    order: Sequence[str] = ("lower", "numbers", "punctuation", "stop_words", "blanks"), late_words: Sequence[str] = (),
) -> Column:
    """Apply the named cleaning steps in the given order.

    Steps: lower, numbers, punctuation, stop_words, blanks, stem, late_words (a second word list, for
    use after stemming).
    """

    def without(t, words):
        return F.array_join(remove_words(F.split(t, r"\s+"), words), " ")

    steps = {
        "lower": F.lower,
        "numbers": lambda t: F.regexp_replace(t, "[0-9]+", ""),
        "punctuation": lambda t: F.regexp_replace(t, PUNCTUATION, ""),
        "stop_words": lambda t: without(t, stop_words) if stop_words else t,
        "blanks": lambda t: F.regexp_replace(t, r"\s+", " "),
        "stem": lambda t: F.array_join(F.transform(F.split(t, r"\s+"), stem), " "),
        "late_words": lambda t: without(t, late_words) if late_words else t,
    }
    for step in order:
        text = steps[step](text)
    return text


def split_sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def ngrams(tokens: Column, low: int = 1, high: int = 3, joiner: str = " ") -> Column:
    """All n-grams of ``low`` to ``high`` tokens, each joined by a blank."""

    def gram_of(n):
        return lambda start: F.array_join(F.slice(tokens, start, n), joiner)

    parts = []
    for n in range(low, high + 1):
        count = F.size(tokens) - (n - 1)
        starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, gram_of(n)))
    return F.concat(*parts)


# --- English stemming ---------------------------------------------------------------------------

_V = "[aeiouy]"
_C = "[^aeiouy]"
# the region after the first vowel-consonant pair, and the same again inside it
_R1 = f"(?>gener|commun|arsen|.*?{_V}{_C})"
_R2 = f"{_R1}(?>.*?{_V}{_C})"
_SHORT_END = f"(?:^{_V}{_C}|{_C}{_V}[^aeiouywxY])$"

# Words the public English (Porter2) stemmer maps as a whole or leaves alone.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_FINAL = "inning|outing|canning|herring|earring|proceed|exceed|succeed"
# Suffix replacements inside R1 (steps 2 and 3) and deletions inside R2 (step 4).
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "ization": "ize",
    "izer": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful",
    "lessli": "less",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


def _by_longest(word: Column, rules: Sequence[tuple[str, Column]]) -> Column:
    """The result of the rule with the longest matching suffix, else the word."""
    out = None
    for suffix, result in sorted(rules, key=lambda r: -len(r[0])):
        out = F.when(word.endswith(suffix), result) if out is None else out.when(word.endswith(suffix), result)
    return out.otherwise(word)


def _swap(word: Column, region: str, suffix: str, new: str, after: str = "") -> Column:
    return F.regexp_replace(word, f"^({region}.*{after}){suffix}$", "$1" + new)


def _prepare(w: Column) -> Column:
    w = F.regexp_replace(w, "^'+|'s'$|'s$|'$", "")
    return F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "(?<=[aeiou])y", "Y")


def _plural(w: Column) -> Column:
    shorten = lambda end: F.regexp_replace(F.regexp_replace(w, f"^(.){end}$", "$1ie"), f"(..){end}$", "$1i")
    w = _by_longest(
        w,
        [
            ("sses", F.regexp_replace(w, "es$", "")),
            ("ied", shorten("ied")),
            ("ies", shorten("ies")),
            ("us", w),
            ("ss", w),
            ("s", F.regexp_replace(w, f"^(.*{_V}.+)s$", "$1")),
        ],
    )
    # '!' ends the work on a word, '#' marks a removed ending
    return F.regexp_replace(w, f"^({_FINAL})$", "$1!")


def _past_and_gerund(w: Column) -> Column:
    return F.when(w.rlike("eed(ly)?$"), F.regexp_replace(w, f"^({_R1}.*)eed(?:ly)?$", "$1ee")).otherwise(
        F.regexp_replace(w, f"^(.*{_V}.*)(?:ingly|edly|ing|ed)$", "$1#")
    )


def _mend(w: Column) -> Column:
    bare = F.regexp_replace(w, "#$", "")
    return (
        F.when(~w.endswith("#"), w)
        .when(bare.rlike("(at|bl|iz)$"), F.concat(bare, F.lit("e")))
        .when(bare.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.regexp_replace(bare, ".$", ""))
        .when(bare.rlike(_SHORT_END) & ~bare.rlike(f"^{_R1}."), F.concat(bare, F.lit("e")))
        .otherwise(bare)
    )


def _y_to_i(w: Column) -> Column:
    return F.regexp_replace(w, "^(.+[^aeiouy])[yY]$", "$1i")


def _step2(w: Column) -> Column:
    rules = [(s, _swap(w, _R1, s, n)) for s, n in _STEP2.items()]
    rules += [("ogi", _swap(w, _R1, "ogi", "og", "(?<=l)")), ("li", _swap(w, _R1, "li", "", "(?<=[cdeghkmnrt])"))]
    return _by_longest(w, rules)


def _step3(w: Column) -> Column:
    rules = [(s, _swap(w, _R1, s, n)) for s, n in _STEP3.items()]
    return _by_longest(w, rules + [("ative", _swap(w, _R2, "ative", ""))])


def _step4(w: Column) -> Column:
    rules = [(s, _swap(w, _R2, s, "")) for s in _STEP4]
    return _by_longest(w, rules + [("ion", _swap(w, _R2, "ion", "", "(?<=[st])"))])


def _step5(w: Column) -> Column:
    bare = F.regexp_replace(w, ".$", "")
    in_r1, in_r2 = bare.rlike(f"^{_R1}.*$"), bare.rlike(f"^{_R2}.*$")
    drop = (w.endswith("e") & (in_r2 | (in_r1 & ~bare.rlike(_SHORT_END)))) | (w.endswith("ll") & in_r2)
    return F.lower(F.regexp_replace(F.when(drop, bare).otherwise(w), "!$", ""))


def stem(word: Column) -> Column:
    """English Porter2 stem of one lower-case word.

    Each step is bound through a one-element array, so its input is computed once.
    """
    held = F.array(word)
    for step in (_prepare, _plural, _past_and_gerund, _mend, _y_to_i, _step2, _step3, _step4, _step5):
        held = F.transform(held, step)
    special = F.create_map(*[F.lit(x) for pair in _SPECIAL.items() for x in pair])
    return F.when(F.length(word) <= 2, word).otherwise(F.coalesce(F.element_at(special, word), held[0]))
