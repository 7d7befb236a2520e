"""Column expressions on text: normalisation, counts, predicates. None runs row by row in Python."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..policy import ARTIFACTS, FULL_WIDTH, LINE_BREAK, SECTION, Policy


#: Characters that normal form C leaves as they are, whatever their neighbours but combining marks: up to U+02FF, dashes and
#: quotation marks, unified ideographs and their punctuation, full-width forms. Only texts with others leave the JVM.
_STABLE = r"^[\x{0}-\x{2FF}\x{2010}-\x{2027}\x{3001}-\x{3029}\x{4E00}-\x{9FFF}\x{FF01}-\x{FF5E}]*$"
_SPACE_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_RARE_BREAKS = r"[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def nfc(x: Column) -> Column:
    """Unicode normal form C; the one normalisation without a builtin, done on Arrow batches of the texts that may need it."""

    def normal(texts: pa.Array) -> pa.Array:
        from unicodedata import normalize

        return pa.array([t if t is None else normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return F.coalesce(F.arrow_udf(normal, StringType())(F.when(~x.rlike(_STABLE), x)), x)


def stripped(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(x, F.lit(_SPACE_CHARS))


def full_width(x: Column) -> Column:
    return F.translate(x, "".join(FULL_WIDTH), "".join(FULL_WIDTH.values()))


def lines(x: Column) -> Column:
    """Lines at all ten terminators, CRLF as one; the empty end after a last terminator stays and is filtered later."""
    return F.when(x.rlike(_RARE_BREAKS), F.split(x, LINE_BREAK, -1)).otherwise(F.split(x, "\n", -1))


def canonical(x: Column, policy: Policy) -> Column:
    """Letters of the policy alone."""
    return F.regexp_replace(x, f"[^{policy.letters}]", "")


def letter_count(x: Column, policy: Policy) -> Column:
    return F.length(F.regexp_replace(x, f"[^{policy.letters}]+", ""))


def allowed(x: Column, policy: Policy) -> Column:
    return x.rlike(policy.allowed)


def characters(x: Column) -> Column:
    """The characters of a text; of an empty one none."""
    return F.filter(F.split(x, ""), lambda c: c != "")


def shingles(x: Column, n: int = 5) -> Column:
    """The set of n-character shingles; a shorter text is its own, an empty one the empty string.

    The text is cut into characters once, as the only element of an array that a lambda binds, so the work grows with its
    length."""
    of = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(c) - (n - 1))), lambda i: F.array_join(F.slice(c, i, F.lit(n)), ""))
    return F.array_distinct(F.transform(F.array(characters(x)), of)[0])


def anchors(x: Column, n: int = 5, k: int = 8) -> Column:
    """The k smallest distinct CRC-32 of the shingles."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(shingles(x, n), lambda s: F.crc32(s.cast("binary"))))), 1, k)


def sha_anchors(x: Column, n: int = 5, k: int = 8) -> Column:
    """The k smallest distinct shingle digests by the first eight hex digits of SHA-256; any SQL engine can make these."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(shingles(x, n), lambda s: F.substring(F.sha2(s, 256), 1, 8)))), 1, k)


def artifact_reason(x: Column) -> Column:
    """The first of the leftovers of markup removal, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(ARTIFACTS.items()):
        out = F.when(x.rlike(pattern), name).otherwise(out)
    return out


def repeated_character(x: Column, run: int = 10) -> Column:
    return x.rlike(r"(.)\1{%d,}" % (run - 1))


def repeated_unit(x: Column, longest: int = 16, times: int = 6) -> Column:
    return x.rlike(r"(.{1,%d})\1{%d,}" % (longest, times - 1))


def spam(x: Column, phrases: tuple[str, ...]) -> Column:
    return x.rlike("(?i)" + "|".join(f"\\Q{p}\\E" for p in phrases)) if phrases else F.lit(False)


def balanced(x: Column, pairs: dict[str, str]) -> Column:
    """Whether opening and closing marks match as a stack does."""
    opening, closing = F.lit("".join(pairs)), F.lit("".join(pairs.values()))
    marks = F.filter(F.split(x, ""), lambda c: (c != "") & (F.position(c, opening) + F.position(c, closing) > 0))

    def step(stack: Column, c: Column) -> Column:
        top = F.right(stack, F.lit(1))
        match = (F.position(c, closing) > 0) & (stack != "") & (F.position(top, opening) == F.position(c, closing))
        return (
            F.when(stack == "!", stack)
            .when(F.position(c, opening) > 0, F.concat(stack, c))
            .when(match, F.substring(stack, F.lit(1), F.length(stack) - 1))
            .otherwise(F.lit("!"))
        )

    return F.aggregate(marks, F.lit(""), step) == ""


def quality_reason(x: Column, policy: Policy, pairs: dict[str, str], phrases: tuple[str, ...] | None = None) -> Column:
    """The first failing test of five, or null; phrases are the policy's unless given."""
    return (
        F.when(x.rlike(policy.fragment), "leading_fragment")
        .when(~x.rlike(policy.sentence_end), "no_sentence_ending")
        .when(repeated_unit(x), "repetition")
        .when(spam(x, policy.phrases if phrases is None else phrases), "boilerplate_or_spam")
        .when(~balanced(x, pairs), "unbalanced_delimiters")
    )


def reject_reason(x: Column, policy: Policy, converted: Column | None = None) -> Column:
    """The one reason that rejects a normalised line, in the order of the tests, or null.

    converted is the line after dictionary conversion; lines outside the alphabet never need it, and it is tested again.
    """
    y = x if converted is None else converted
    foreign = ~allowed(x, policy) if converted is None else ~allowed(x, policy) | ~allowed(y, policy)
    out = F.when(foreign, "symbols")
    if policy.full_width:  # artifacts hold full-width marks; an alphabet without these has none
        out = out.when(artifact_reason(y).isNotNull(), artifact_reason(y))
    out = out.when(letter_count(y, policy) < policy.least, "short").when(F.length(y) > policy.most, "long")
    return out.when(repeated_character(y, policy.run), "repeated_character")


def converted(x: Column, mapping: dict[str, str]) -> Column:
    """Dictionary conversion by longest match; with single characters only it is one translate()."""
    if all(len(k) == 1 and len(v) == 1 for k, v in mapping.items()):
        return F.translate(x, "".join(mapping), "".join(mapping.values()))
    import re

    pattern = re.compile("|".join(map(re.escape, sorted(mapping, key=len, reverse=True))))

    def phrases(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else pattern.sub(lambda m: mapping[m[0]], t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(phrases, StringType())(x)


def plain_wikitext(x: Column) -> Column:
    """Wikitext without templates (innermost first, four levels), tags, file and category links; visible link text stays."""
    for _ in range(4):
        x = F.regexp_replace(x, r"\{\{[^{}]*\}\}", "\n")
    x = F.regexp_replace(x, r"(?is)<(ref|table|math|gallery|code|timeline)\b[^>]*?(?:/>|>.*?</\1>)", "\n")
    x = F.regexp_replace(x, r"(?i)\[\[(?:file|image|category|文件|图像|分类):[^\[\]]*\]\]", "\n")
    x = F.regexp_replace(x, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")
    x = F.regexp_replace(x, r"\[https?://\S+ ([^\]]*)\]", "$1")
    return F.regexp_replace(F.regexp_replace(x, r"'{2,5}", ""), r"<[^>]+>", "")


def markdown_lines(x: Column) -> Column:
    """Non-empty lines of a Markdown field: bold marks and blanks beside full-width marks go, headings end in a colon."""
    def clean(line: Column) -> Column:
        body = F.regexp_replace(line, r"^#{1,6}[\s\x{3000}]+", "")
        body = F.regexp_replace(body, r"\*\*([^*]+)\*\*", "$1")
        body = F.regexp_replace(F.regexp_replace(body, r"([，。！？；：、])[ \t\x{3000}]+", "$1"), r"[ \t\x{3000}]+([，。！？；：、])", "$1")
        return F.when(line.rlike(r"^#{1,6}[\s\x{3000}]+") & ~body.rlike("[：。！？]$"), F.concat(body, F.lit("："))).otherwise(body)

    own = F.filter(F.transform(lines(full_width(nfc(x))), stripped), lambda line: line != "")
    return F.transform(own, clean)


def pure_field(x: Column, policy: Policy) -> Column:
    """All lines joined if each is of the alphabet and free of artifacts, else null; nothing for an empty field."""
    own = markdown_lines(x)
    return F.when(F.forall(own, lambda line: allowed(line, policy) & artifact_reason(line).isNull()), F.array_join(own, ""))


def qa_text(question: Column, extra: Column, answer: Column, policy: Policy) -> Column:
    """A whole question and answer or nothing; an empty supplement is left out, a bad one spoils the pair."""
    q, e, a = (pure_field(c, policy) for c in (question, F.coalesce(extra, F.lit("")), answer))
    whole = F.concat(F.lit("问："), q, F.when(e == "", "").otherwise(F.concat(F.lit("补充："), e)), F.lit("答："), a)
    return F.when((q != "") & (a != "") & e.isNotNull(), whole)


def domain(x: Column, family: Column, hint: Column, families: tuple[str, ...], keywords: dict[str, tuple[str, ...]]) -> tuple[Column, Column]:
    """(label, method): the first keyword family with most distinct hits if that is two or more, else the source's hint."""
    score = {k: sum((x.contains(w).cast("int") for w in ws), F.lit(0)) for k, ws in keywords.items()}
    best = F.greatest(*score.values())
    label = F.lit(None).cast("string")
    for k in reversed(score):
        label = F.when(score[k] == best, F.lit(k)).otherwise(label)
    heuristic = family.isin(*families) & (best >= 2)
    return F.when(heuristic, label).otherwise(hint), F.when(heuristic, F.lit("heuristic")).otherwise(F.lit("source"))


def domain_hits(x: Column, keywords: dict[str, tuple[str, ...]]) -> Column:
    return F.greatest(*[sum((x.contains(w).cast("int") for w in ws), F.lit(0)) for ws in keywords.values()])


def boundary(x: Column) -> Column:
    """A section heading, or a title in brackets of at most 80 characters."""
    return x.rlike(SECTION) | (F.startswith(x, F.lit("【")) & F.endswith(x, F.lit("】")) & (F.length(x) <= 80))


def category(label: Column, policy: Policy) -> Column:
    """letter or punctuation; anything else is an error."""
    return F.when(label.rlike(f"^[{policy.letters}]$"), "letter").when(label.rlike(r"^\p{P}$"), "punctuation").otherwise(F.raise_error(F.concat(F.lit("neither letter nor punctuation: "), label)))


def document_id(text: Column, *fields: Column) -> Column:
    """SHA-256 of the text, or without one of the JSON of its fields."""
    return F.sha2(F.coalesce(text, F.to_json(F.struct(*fields)) if fields else F.lit("")), 256)


def typed_list(x: Column, kind: str) -> Column:
    """A comma-separated list as its sorted distinct typed values."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(x, ","), lambda p: F.trim(p) != ""), lambda p: F.trim(p).cast(kind))))


def sample_parts(x: Column) -> Column:
    """file:row:unit as a struct of three longs."""
    return F.struct(*[F.split_part(x, F.lit(":"), F.lit(n)).cast("long").alias(c) for n, c in ((1, "file"), (2, "row"), (3, "unit"))])


def structure_class(definition: Column, character: Column) -> Column:
    """0 atomic, 1 to 12 by the leading operator of a decomposition, 13 any other."""
    operators = F.array(*[F.lit(chr(0x2FF0 + k)) for k in range(12)])
    at = F.array_position(operators, F.left(definition, F.lit(1))).cast("int")
    return F.when(definition.isNull() | (definition == character), 0).when(at > 0, at).otherwise(13)


def layout_rows(x: Column, columns: int = 20) -> Column:
    """Rows of a grid that a text fills. Line breaks pad their row, and each further one an empty row, once a character
    follows; carriage returns are dropped."""

    def step(s: Column, c: Column) -> Column:
        at, breaks, over = s["at"], s["breaks"], s["at"] % columns
        pad = F.when(breaks == 0, 0).when(at == 0, breaks * columns).when(over == 0, (breaks - 1) * columns).otherwise(breaks * columns - over)
        at_next = F.when(c == "\n", at).otherwise(at + pad + 1)
        return F.struct(at_next.cast("long").alias("at"), F.when(c == "\n", breaks + 1).otherwise(0).cast("long").alias("breaks"))

    chars = F.filter(F.split(F.regexp_replace(x, "\r", ""), ""), lambda c: c != "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("breaks"))
    return F.aggregate(chars, start, step, lambda s: F.ceil(s["at"] / columns).cast("long"))


def text_id_ordinal(seed: str, key: Column, modulus: int = 1000) -> Column:
    """The first 32 bits of SHA-256 of seed:key, modulo."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256), 1, 8), 16, 10).cast("long") % modulus


def typed_numbers(x: Column, forms: dict[str, str]) -> Column:
    """Numbers as the names of their forms in angle brackets, in the order of the forms."""
    for name, pattern in forms.items():
        x = F.regexp_replace(x, pattern, f"<{name}>")
    return x


def legal_prefix(docs, key: str, text: Column, policy: Policy):
    """(key, legal, sentence, letters, substantial): the length of the longest beginning of the alphabet, of it up to its last
    sentence end, its letters, and whether these are 8 or more, 4 of them distinct."""
    begun = docs.select(key, F.regexp_extract(text, f"^[{policy.letters}{policy.marks}]*", 0).alias("p"))
    letters = F.filter(characters(F.col("p")), lambda c: c.rlike(f"[{policy.letters}]"))
    own = begun.select(key, "p", F.regexp_extract("p", r"(?s)^.*[.!?]", 0).alias("s"), letters.alias("l"))
    n = F.size("l").cast("long")
    return own.select(key, F.length("p").cast("long").alias("legal"), F.length("s").cast("long").alias("sentence"), n.alias("letters"), ((n >= 8) & (F.size(F.array_distinct("l")) >= 4)).alias("substantial"))
