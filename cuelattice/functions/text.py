"""Text expressions for cues: punctuation widths, normal keys, residue and filler removal, repetition, lookups."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionary import DEFAULT

CJK = "㐀-䶿一-鿿豈-﫿"
CJK_BASIC = "一-鿿"
WIDE = {",": "，", ".": "。", "?": "？", "!": "！", ":": "：", ";": "；"}
FILLERS = ("OK", "Ok", "ok", "哎", "啊", "嗯", "嗯嗯", "在", "好", "對", "我", "欸")
PRONOUNS = ("他", "她", "它", "他們", "她們", "它們")
_TAG = "(?:antml:)?(?:" + "|".join(("tool_result", "tool_use", "content", "function_calls", "parameters?", "invoke")) + ")"
TAG_RESIDUE = "|".join([rf"</?{_TAG}/?(?:\s[^<>]*)?>", rf"</?{_TAG}(?:\s[^<>]*)?$", rf"^/?{_TAG}>", r'^[\p{L}\p{N}_:]+="[^"]*"\s*(?:>|/>)', r"</?\s*$"])
TAG_LINE = r"(?i)^</?(?:antml:[a-z_]+|function_calls|parameter|content|invoke)\b[^>]*>$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def is_cjk(c: str | Column, basic: bool = False) -> Column:
    """Whether the text is one ideograph (of the basic block only, or also of extension A and the compatibility block)."""
    return _col(c).rlike(f"^[{CJK_BASIC if basic else CJK}]$")


def half_to_full(c: str | Column) -> Column:
    """, . ? ! : ; become full-width where the character just before or just after is an ideograph."""
    out = _col(c)
    for half, full in WIDE.items():
        out = F.regexp_replace(out, f"(?<=[{CJK}])\\{half}|\\{half}(?=[{CJK}])", full)
    return out


def fullwidth_norm(c: str | Column) -> Column:
    """Commas not between digits become full-width and take one following space; ? and ! do after an ideograph (spaces between them allowed)."""
    # patterns begin with a character, so that nothing is looked back for at every place
    out = F.regexp_replace(_col(c), r",(?<!\d,) ?(?!\d)", "，")
    for half in "?!":
        out = F.regexp_replace(out, f"([{CJK}] *+)\\{half}", f"$1{WIDE[half]}")
    return out


def widen_commas(c: str | Column) -> Column:
    """Every comma becomes full-width, except on lines that are time codes."""
    return F.when(_col(c).contains("-->"), _col(c)).otherwise(F.replace(_col(c), F.lit(","), F.lit("，")))


def latin_to_half(c: str | Column) -> Column:
    """Full-width letters and digits become ASCII; full-width punctuation stays."""
    wide = "".join(chr(ord(x) + 0xFEE0) for x in _ALNUM)
    return F.translate(_col(c), wide, _ALNUM)


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def strip_punct(c: str | Column) -> Column:
    """Without ，。、？！,. and white space: the form in which cues are compared."""
    return F.regexp_replace(_col(c), r"(?U)[，。、？！,.\s]", "")


def dup_key(c: str | Column) -> Column:
    """Letters and digits of any script only."""
    return F.regexp_replace(_col(c), r"(?U)[\W_]", "")


def strip_trailing_punct(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), "[。，.,]+$", "")


def is_noise(wrong: str | Column, correct: str | Column) -> Column:
    """Whether a replacement teaches nothing: an empty side, over 10 characters, a change of case or of pronoun, or punctuation."""
    w, c = strip(_col(wrong)), strip(_col(correct))
    punct = r"(?U)^[\p{P}\p{S}\s]+$"
    return (w == "") | (c == "") | (F.length(w) > 10) | (F.length(c) > 10) | (F.lower(w) == F.lower(c)) | w.rlike(punct) | c.rlike(punct) | (w.isin(*PRONOUNS) & c.isin(*PRONOUNS))


def suggest_destination(wrong: str | Column) -> Column:
    """preprocess for a phrase that can be replaced blindly, terms for single characters and ASCII tokens."""
    w = strip(_col(wrong))
    return F.when((F.length(w) >= 2) & ~w.rlike(r"^[\w&.+#-]+$"), "preprocess").otherwise("terms")


def strip_tag_residue(c: str | Column, rounds: int = 8) -> Column:
    """Without leaked tool tags, taken off again and again (up to `rounds` nested layers) and trimmed."""
    out = _col(c)
    for _ in range(rounds):
        out = strip(F.regexp_replace(out, TAG_RESIDUE, ""))
    return out


def strip_tag_lines(c: str | Column) -> Column:
    """Without the lines that are one tool tag and nothing else."""
    return F.array_join(F.filter(F.split(_col(c), "\n"), lambda x: ~strip(x).rlike(TAG_LINE)), "\n")


def is_commentary(c: str | Column) -> Column:
    """Whether a line is a reviewer's remark rather than a subtitle."""
    s = strip(_col(c))
    starts = "→ [ 原文通順 此條通順 請確認 確認為股票代號 但可加逗號 但後文 若上條 應是「".split()
    verdict = s.endswith("]") & s.rlike("不改|通順|確認|OK|可讀性")
    return (s != "") & (s.isin("不改]", "非 ASR 錯誤") | verdict | s.rlike("^(?:" + "|".join(x.replace("[", "\\[") for x in starts) + ")"))


def delete_inline_fillers(c: str | Column) -> Column:
    """Without an opening 好 or 那 that carries nothing and a closing 啦; trimmed if that changed anything."""
    out = _col(c)
    for pattern in (r"^好[，,]\s*", "^好(?=[這那所以大家們它她他你我])", "^那(?=這個[^人事物])", "^那(?=這個$)", "啦$"):
        out = F.regexp_replace(out, pattern, "")
    return F.when(out == _col(c), _col(c)).otherwise(strip(out))


def is_standalone_filler(c: str | Column, fillers: Iterable[str] = FILLERS) -> Column:
    return strip(_col(c)).isin(*fillers)


def terminology(c: str | Column, rules: Mapping[str, str]) -> Column:
    """Terms (matched without case, as whole ASCII words also beside ideographs) in their right spelling, longer ones first."""
    out = _col(c)
    for wrong in sorted(rules, key=lambda x: (-len(x), x)):
        out = F.regexp_replace(out, rf"(?i)(?<![A-Za-z0-9_])\Q{wrong}\E(?![A-Za-z0-9_])", rules[wrong].replace("\\", "\\\\").replace("$", "\\$"))
    return out


def tickers(c: str | Column, stop: Iterable[str] = DEFAULT.window_titles) -> Column:
    """Distinct sorted runs of 2 to 5 capitals that stand alone, without those of the stop list (titles of windows)."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(_col(c), F.lit(r"(?U)\b[A-Z]{2,5}\b"), F.lit(0))), F.array(*[F.lit(x) for x in stop])))


def context_snippet(text: str | Column, hit: str | Column, around: int = 8, head: int = 20) -> Column:
    """The first hit with so many characters on both sides; without a hit, the head of the text."""
    t, h = _col(text), _col(hit)
    at = F.instr(t, h)
    start = F.greatest(F.lit(1), at - around)
    return F.when((at > 0) & (h != ""), F.substring(t, start, at - start + F.length(h) + around)).otherwise(F.substring(t, 1, head))


def token_estimate(block: str | Column) -> Column:
    """Tokens of a block with its empty line, one for each character: the measure without a tokenizer."""
    return F.length(_col(block)) + 2


def fenced_json(c: str | Column) -> Column:
    """What stands in the first ```json fence, else the first [...] of the text, else the text; trimmed."""
    t = _col(c)
    fence = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    array = F.regexp_extract(t, r"(?s)\[.*\]", 0)
    return strip(F.when(fence != "", fence).when(array != "", array).otherwise(t))


def first_key(m: str | Column, *keys: str) -> Column:
    """The value of the first key that the map holds."""
    return F.coalesce(*[F.try_element_at(_col(m), F.lit(k)) for k in keys])


def length_flags(c: str | Column, limit: int = 20, far: int = 40) -> Column:
    n = F.length(_col(c))
    return F.struct(n.alias("char_len"), (n > limit).alias("over"), (n > far).alias("far_over"))


def build_prompt(template: str | Column, **parts: Column) -> Column:
    """The template with {name} replaced by each part; an empty or null part leaves nothing."""
    out = _col(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def convert_phrases(c: str | Column, phrases: Mapping[str, str], characters: Mapping[str, str]) -> Column:
    """Script conversion: phrases first, longest first, then single characters."""
    out = _col(c)
    for p in sorted(phrases, key=lambda x: (-len(x), x)):
        out = F.replace(out, F.lit(p), F.lit(phrases[p]))
    return F.translate(out, "".join(characters), "".join(characters.values()))


def hash_matches(text: str | Column, recorded: str | Column) -> Column:
    """Whether a side table made for this text is still fresh: false for a missing or other SHA-256."""
    return F.coalesce(F.sha2(_col(text), 256) == _col(recorded), F.lit(False))


def repeated_run(c: str | Column, times: int = 10) -> Column:
    """Whether one character stands `times` times in a row."""
    return _col(c).rlike(rf"(\S)\1{{{times - 1}}}")


def _gram(t: Column, n: int):
    return lambda i: F.substring(t, i, F.lit(n))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body has it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _grams(t: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), _gram(t, n))


def _found(t: Column, n: int, gram: Column, count: Column, share: Column, least: int, ratio: float) -> Column:
    return F.when((F.length(t) >= 10) & (count >= least) & (share >= ratio), F.struct(F.lit(n).alias("n"), gram.alias("gram"), count.alias("count"), share.alias("ratio")))


def repetition(c: str | Column, ratio: float = 0.8, least: int = 10) -> Column:
    """Struct (n, gram, count, ratio) of the smallest n of 1, 2, 3 whose commonest gram makes `ratio` of all n-grams and occurs `least` times; null if none.

    Of equally common grams the first counts. Texts of fewer than 10 characters, without punctuation and white space, have none.
    """
    t = F.regexp_replace(_col(c), r"(?U)[，,。！？、\s]", "")
    if ratio > 0.5:  # then only the gram in the middle of the sorted ones can make the ratio
        return _let(t, lambda t: F.coalesce(*[_let(_grams(t, n), lambda g, n=n: _let(F.sort_array(g)[F.floor(F.size(g) / 2).cast("int")], lambda x: _let(F.size(g) - F.size(F.array_remove(g, x)), lambda k: _found(t, n, x, k, k / F.size(g), least, ratio)))) for n in (1, 2, 3)]))
    found = []
    for n in (1, 2, 3):
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), _gram(t, n))
        sorted_grams = F.array_sort(grams)
        # the commonest gram by one pass over the sorted grams would lose the order; few distinct grams are the case that counts
        best = F.array_max(F.transform(F.array_distinct(sorted_grams), lambda x: F.struct((F.size(grams) - F.size(F.array_remove(grams, x))).alias("count"), (-F.array_position(grams, x)).alias("at"), x.alias("gram"))))
        share = best["count"] / F.size(grams)
        found.append(F.when((F.length(t) >= 10) & (best["count"] >= least) & (share >= ratio), F.struct(F.lit(n).alias("n"), best["gram"].alias("gram"), best["count"].alias("count"), share.alias("ratio"))))
    return F.coalesce(*found)


def cjk_commas_repaired(c: str | Column, lexicon: Mapping[str, int], least: int = 500) -> Column:
    """A full-width comma inside a word goes: between two ideographs that are a common word together, unless the two before it are one as well.

    lexicon holds words and frequencies (a small dictionary; texts are looked at once for each common word of two ideographs in it).
    """
    common = [w for w, n in lexicon.items() if n >= least and len(w) == 2]
    out = _col(c)
    if not common:
        return out
    for w in sorted(common):
        before = [x[0] for x in common if x[1] == w[0]]
        guard = f"(?<![{''.join(before)}](?={w[0]}))" if before else ""
        out = F.regexp_replace(out, f"{guard}{w[0]}，{w[1]}", w)
    return out
