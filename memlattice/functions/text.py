"""Text functions, column to column."""

from __future__ import annotations

import collections
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks an update.
UPDATE_MARKERS = ("更新", "变更", "改为", "改成", "调整", "升级", "目前", "现在", "之前", "原先", "最新", "supersed", "updated", "changed", "currently", "previously")
#: A JSON key that has one of these holds a secret.
SENSITIVE = ("api_key", "api-key", "apikey", "token", "secret", "password", "passwd", "credential", "auth", "authorization", "bearer", "access_key", "accesskey", "private_key", "privatekey", "ssl_key", "ssh_key", "admin_key", "adminkey")


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the same without them, by their canonical decomposition."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in (*range(0xDF, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, d[0]) for c, d in pairs if d != c and d[0].isascii() and d[0].islower()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


_MARKED, _BARE = _accents()
_TABLE = str.maketrans(_MARKED, _BARE)


def fold(c: Column) -> Column:
    """Lower case, Latin letters without their marks; a text of ASCII alone takes the short way."""
    low = F.lower(c)
    return F.when(F.octet_length(c) == F.length(c), low).otherwise(F.regexp_replace(F.translate(low, _MARKED, _BARE), r"\p{Mn}", ""))


def tokens(c: Column) -> Column:
    """Runs of letters and digits of any script, folded."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_tokens(c: Column) -> Column:
    """What a query asks for: its distinct tokens, code symbols cut at _ . / and -, without single Chinese characters and the mark `pattern`."""
    return F.filter(F.array_distinct(tokens(c)), lambda t: (t != "pattern") & ~t.rlike("^[一-鿿]$"))


def words_in_chinese(c: Column) -> Column:
    """a-z as characters from 一 on: stands in for Chinese text where the data has none."""
    return F.translate(F.lower(c), "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + i) for i in range(26)))


def content_id(c: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text."""
    return F.substring(F.sha2(c, 256), 1, 16)


def numbers(c: Column) -> Column:
    """Distinct numbers of at most 24 characters, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1), lambda x: F.length(x) <= 24))


def dates(c: Column) -> Column:
    """Distinct YYYY-MM-DD or YYYY/MM/DD dates, with dashes, in order; no calendar check."""
    found = F.regexp_extract_all(c, F.lit(r"([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2})"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit("/"), F.lit("-"))))


def update_markers(c: Column) -> Column:
    low = F.lower(c)
    return F.filter(F.array(*map(F.lit, UPDATE_MARKERS)), lambda m: F.contains(low, m))


def has_cjk(c: Column) -> Column:
    return c.rlike("[一-鿿]")


def mostly_chinese(c: Column) -> Column:
    cjk = F.length(F.regexp_replace(c, "[^一-鿿㐀-䶿]", ""))
    rest = F.length(F.regexp_replace(c, r"\s", ""))
    return (rest > 0) & (2 * cjk >= rest)


def sentences(c: Column) -> Column:
    """Cut after any of 。！？!?；; or a line end; trimmed, without empty ones."""
    cut = F.split(F.regexp_replace(c, "([。！？!?；;\n])", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), lambda s: s != "")


def chunk_text(c: Column, size: int = 3500, overlap: int = 200) -> Column:
    """Windows of `size` characters, each beginning `overlap` before the last one's end."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(c) - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(c, i * step + 1, F.lit(size)))


def relative_dates(c: Column, anchor: str) -> Column:
    """Dates that Chinese words for yesterday, last week or next month mean on the day of the anchor, in order of this list."""
    day = F.lit(anchor).cast("date")
    week, month, year = F.trunc(day, "week"), F.trunc(day, "MM"), F.trunc(day, "YYYY")
    said = [(("今天", "今日", "当日", "当天"), day), (("昨天", "昨日"), F.date_sub(day, 1)), (("明天", "明日"), F.date_add(day, 1)), (("前天",), F.date_sub(day, 2)), (("后天",), F.date_add(day, 2))]
    said += [(("上周",), F.date_sub(week, 7)), (("本周", "这周"), week)]
    for n, name in enumerate("一二三四五六日"):
        said += [((f"上周{name}",), F.date_add(week, n - 7)), ((f"本周{name}", f"这周{name}"), F.date_add(week, n))]
    said += [(("上月", "上个月"), F.add_months(month, -1)), (("本月", "这个月"), month), (("下月", "下个月"), F.add_months(month, 1)), (("今年",), year), (("去年",), F.add_months(year, -12))]
    found = (F.when(c.rlike("|".join(words)), F.date_format(d.cast("date"), "yyyy-MM-dd")) for words, d in said)
    # one look tells most texts apart from those that need all the others
    return F.when(c.rlike("[天日周月年]"), F.array_distinct(F.array_compact(F.array(*found)))).otherwise(F.array().cast("array<string>"))


def occurred(tags: Column) -> Column:
    """The date of the first well-formed `occurred:` tag."""
    return F.regexp_extract(F.array_join(F.filter(tags, lambda t: t.rlike("^occurred:[0-9]{4}-[0-9]{2}-[0-9]{2}")), ","), "^occurred:([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)


def with_occurred(tags: Column, day: Column) -> Column:
    """Tags with one `occurred:` tag, that of the day (its first ten characters); without a well-formed day they stay as they are."""
    fine = day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    rest = F.filter(tags, lambda t: ~t.startswith("occurred:"))
    return F.when(fine, F.array_append(rest, F.concat(F.lit("occurred:"), F.substring(day, 1, 10)))).otherwise(tags)


def signal_tags(tags: Column, content: Column) -> Column:
    """Tags with the signals of the content: old signal tags go, numbers (8), dates (4) and markers (4) are added."""
    rest = F.filter(tags, lambda t: ~t.startswith("signal:"))
    named = lambda values, n, name: F.transform(F.slice(values, 1, n), lambda x: F.concat(F.lit(f"signal:{name}:"), x))
    return F.array_distinct(F.concat(rest, named(numbers(content), 8, "num"), named(dates(content), 4, "date"), named(update_markers(content), 4, "update")))


#: How many numbers, dates and markers a text's signals keep.
MOST_SIGNALS = {"num": 8, "date": 4, "update": 4}


def text_signals(content: Column, tags: Column, occurred_at: Column, now: str) -> Column:
    """numbers, dates and update_markers of a text, each with those that its tags keep after its own; a date it occurred at and dates that words mean
    on the day of now come between. A tag that speaks of superseding, or is `pattern`, marks a chain."""
    kept = lambda name: F.transform(F.filter(tags, lambda t: t.startswith(f"signal:{name}:")), lambda t: F.substr(t, F.lit(len(f"signal:{name}:") + 1)))
    none = F.array().cast("array<string>")
    day = F.when(F.coalesce(occurred_at, F.lit("")) != "", F.array(occurred_at)).otherwise(none)
    chain = F.when(F.exists(tags, lambda t: F.contains(F.lower(t), F.lit("supersed")) | (F.lower(t) == "pattern")), F.array(F.lit("supersede_chain"))).otherwise(none)
    parts = {"num": ("numbers", F.concat(numbers(content), kept("num"))), "date": ("dates", F.concat(dates(content), day, relative_dates(content, now[:10]), kept("date"))), "update": ("update_markers", F.concat(update_markers(content), kept("update"), chain))}
    return F.struct(*(F.slice(F.array_distinct(c), 1, MOST_SIGNALS[k]).alias(name) for k, (name, c) in parts.items()))


def safe_filename(c: Column) -> Column:
    """The last part of a path with other characters than ASCII letters, digits, dot, dash and underscore replaced."""
    return F.regexp_replace(F.regexp_extract(c, "([^/]*)/*$", 1), r"[^A-Za-z0-9._-]", "_")


def ns_folder(c: Column) -> Column:
    """A namespace as a folder's name: slashes become underscores, other characters go."""
    return F.regexp_replace(F.regexp_replace(c, r"[/\\\\]", "_"), r"[^A-Za-z0-9._-]", "")


def truncate_bytes(c: Column, n: int) -> Column:
    """As many whole characters as n bytes of UTF-8 hold, and an ellipsis if there are more."""
    head = F.substring(c.cast("binary"), 1, n).cast("string")
    whole = F.when(F.try_validate_utf8(head).isNotNull(), head).otherwise(F.regexp_replace(F.make_valid_utf8(head), "\ufffd+$", ""))
    return F.when(F.octet_length(c) > n, F.concat(whole, F.lit("…"))).otherwise(c)


def truncate(c: Column, n: int) -> Column:
    """The first n characters and an ellipsis if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def mask_secrets(c: Column) -> Column:
    """Strings under sensitive JSON keys keep four characters, if they have more, before four stars; text that isn't JSON is masked
    after a sensitive word and one of = : ' up to a comma, blank or closing bracket."""
    keys = "|".join(SENSITIVE)
    key = rf'("[^"]*(?i:{keys})[^"]*"\s*:\s*")'
    in_json = F.regexp_replace(c, key + r'((?:[^"\\]|\\.){4})(?:[^"\\]|\\.)+"', '$1$2****"')
    in_json = F.regexp_replace(in_json, key + r'(?:[^"\\]|\\.){0,4}"', '$1****"')
    word, part = rf"""((?i:{keys})(?:=|'|":|:))""", r"[^,}) \n\r]"
    in_text = F.regexp_replace(c, rf"{word}({part}{{4}}){part}+", "$1$2****")
    in_text = F.regexp_replace(in_text, rf"{word}(?:{part}{{1,4}}(?!{part})|(?=[,}}) \n\r]))", "$1****")
    return F.when(F.try_parse_json(c).isNotNull(), in_json).otherwise(in_text)


def iso_week(c: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("w"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


#: Kinds of files, by their ending, and their content types.
KINDS = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
}


def detect_kind(name: Column, content_type: Column | None = None) -> Column:
    """pdf, docx, xlsx or xls by the name's ending or the content type, in this order; else null."""
    tests = [F.when(F.lower(name).endswith(f".{kind}") | (F.coalesce(content_type == mime, F.lit(False)) if content_type is not None else F.lit(False)), kind) for kind, mime in KINDS.items()]
    return F.coalesce(*tests)


def local_name(iri: Column) -> Column:
    """What follows the last / or #; the whole if that is nothing."""
    last = F.regexp_extract(iri, r"([^/#]*)$", 1)
    return F.when(last == "", iri).otherwise(last)


def normal_iri(iri: Column) -> Column:
    """Without / and # at the end."""
    return F.regexp_replace(iri, r"(?<=.)[/#]+$", "")


#: Predicates that become relations.
RELATION_OF = {
    "references": "references",
    "supersedes": "supersedes",
    "createdBy": "created_by",
    "created_by": "created_by",
    "conflictsWith": "conflicts_with",
    "conflicts_with": "conflicts_with",
    "dependsOn": "depends_on",
    "depends_on": "depends_on",
    "partOf": "part_of",
    "part_of": "part_of",
    "belongsTo": "belongs_to",
    "belongs_to": "belongs_to",
}
#: What a relation between memories may be called.
MEMORY_RELATIONS = {"updates": "updates", "update": "updates", "extends": "extends", "extend": "extends", "derives": "derives", "derive": "derives", "same_entity": "same_entity", "chronological": "chronological", "semantic_related": "semantic_related"}


def memory_relation(c: Column) -> Column:
    """The relation a name stands for: updates if it is null, null if it is none of them."""
    names = F.create_map(*(F.lit(x) for kv in MEMORY_RELATIONS.items() for x in kv))
    return F.element_at(names, F.lower(F.trim(F.coalesce(c, F.lit("updates")))))


def kind_of(category: Column, tags: Column) -> Column:
    """hard_rule before pref, style and insight; else the category."""
    has = lambda *names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
    return F.when(has("hard_rule"), "hard_rule").when(has("pref"), "pref").when(has("style"), "style").when(has("insight", "auto_insight"), "insight").otherwise(category)


def channel_of(source: Column) -> Column:
    """The first channel whose name is in the source, keyword also by like; else the source itself."""
    out = source
    for key, name in (("category", "category"), ("importance", "importance"), ("temporal", "temporal"), ("semantic", "semantic"), ("like", "keyword"), ("keyword", "keyword")):
        out = F.when(F.contains(source, F.lit(key)), name).otherwise(out)
    return out


#: Words of a question and the advice they call for.
ADVICE = {
    "COUNT_TOTAL_DEDUP": ("how many", "total", "count", "数量", "总数", "几个", "多少个", "累计"),
    "RELATIVE_DATE_GROUNDING": ("ago", "before", "after", "last", "next", "yesterday", "tomorrow", "前", "后", "之前", "之后", "昨天", "明天", "上周", "本周", "这周", "上月", "上个月", "下个月", "下月", "去年", "今年", "本月", "今天", "今日", "当日", "当天", "近年", "相对"),
    "AMOUNT_DIFFERENCE_CALIBRATION": ("how much", "difference", "cost", "spent", "amount", "差额", "花了多少", "差多少", "成本", "余额", "多少钱"),
    "CURRENT_PREVIOUS_ARBITRATION": ("current", "latest", "previous", "initially", "before", "当前", "最新", "之前", "最初", "原先", "现在", "过去"),
}


def guardrails(question: Column) -> Column:
    """The advice a question calls for, in this order."""
    return F.array_compact(F.array(*(F.when(F.lower(question).rlike("|".join(words)), name) for name, words in ADVICE.items())))


#: What each piece of advice says.
NOTES = {
    "COUNT_TOTAL_DEDUP": "先枚举唯一事件再计数，避免把同一事件的多次提及重复累加。",
    "RELATIVE_DATE_GROUNDING": "以问题时间为锚点解析相对日期，落到具体记忆的 occurred/mentioned 区间。",
    "AMOUNT_DIFFERENCE_CALIBRATION": "仅当差值两侧数据齐全时才计算，缺一侧时保守表述而非硬算。",
    "CURRENT_PREVIOUS_ARBITRATION": "当前态取最新有效版本(occurred 最近)，历史态取最旧版本，勿混用。",
}


def guardrail_notes(question: Column) -> Column:
    """guardrails() with what each says."""
    said = F.create_map(*(F.lit(x) for kv in NOTES.items() for x in kv))
    return F.transform(guardrails(question), lambda n: F.concat(n, F.lit(": "), F.element_at(said, n)))


def evolved_context(c: Column) -> Column:
    """What a promoted memory's context says: its first 120 characters."""
    body = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.concat(F.lit("[auto-promoted] "), F.when(F.coalesce(body, F.lit("")) == "", "(no content)").otherwise(truncate(body, 120)))


def cjk_shingles(c: Column) -> Column:
    """Distinct runs of two to four Chinese characters."""
    runs = F.split(F.regexp_replace(c, "[^一-鿿]+", " "), " ")

    def grams(n: int) -> Column:
        cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substr(w, i, F.lit(n)))
        return F.flatten(F.transform(F.filter(runs, lambda w: F.length(w) >= n), cut))

    return F.array_distinct(F.concat(*map(grams, (2, 3, 4))))


def keyword_query(content: Column, tags: Column) -> Column:
    """The first eight tags that aren't blank, else the first 40 characters with single blanks."""
    real = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")
    plain = F.substring(F.regexp_replace(F.regexp_replace(content, r"^\s+|\s+$", ""), r"\s+", " "), 1, 40)
    return F.when(F.size(real) > 0, F.array_join(F.slice(real, 1, 8), " ")).otherwise(plain)


def shorten(text: str, limit: int) -> str:
    """The first, the last and the three middle sentences whose tokens are most frequent in the text, in order; cut to the limit.

    Of equally frequent ones the earlier is taken. A text of one sentence becomes its beginning.
    """
    parts = [s.strip(" \t\r\n") for s in re.split("(?<=[。！？!?；;\n])", text)]
    parts = [s for s in parts if s]
    if len(parts) <= 1:
        return text[:limit]

    def found(t: str) -> list[str]:
        low = "".join(c for c in t.lower().translate(_TABLE) if unicodedata.category(c) != "Mn")
        return re.findall(r"[^\W_]+", low)

    often = collections.Counter(found(text))
    middle = sorted(range(1, len(parts) - 1), key=lambda i: (-sum(often[t] for t in found(parts[i])), i))[:3]
    return "".join(parts[i] for i in sorted({0, *middle, len(parts) - 1}))[:limit]


def distill(c: Column, latin: int = 1200, chinese: int = 600) -> Column:
    """Texts over the limit (1200 characters, 600 if mostly Chinese) become what shorten() keeps of them; only these go to Python, in Arrow batches."""
    limit = F.when(mostly_chinese(c), chinese).otherwise(latin)

    def run(text: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else shorten(t, int(m)) for t, m in zip(text, most, strict=True)], dtype=object)

    return F.when(F.length(c) <= limit, c).otherwise(F.pandas_udf(run, "string")(F.when(F.length(c) > limit, c), limit))


def manifest(name: Column, kind: Column, size: Column, text: Column, path: Column) -> Column:
    """What stands for a whole document: its name, kind, sizes, place and first 400 characters."""
    whole = lambda c: c.cast("string")
    parts = [F.lit("[文档] "), name, F.lit("\n类型: "), kind, F.lit("\n大小: "), whole(size), F.lit(" bytes\n字符: "), whole(F.length(text)), F.lit("\n分块: "), whole(F.size(chunk_text(text))), F.lit("\n路径: "), path, F.lit("\n---\n"), F.substring(text, 1, 400)]
    return F.concat(*parts)


def chunk_body(name: Column, place: Column, total: Column, chunk: Column) -> Column:
    """A chunk with its place from 1 and the number of chunks."""
    return F.concat(F.lit("[文档块 "), place.cast("string"), F.lit("/"), total.cast("string"), F.lit("] "), name, F.lit("\n\n"), chunk)


#: Colours of categories, sizes of tiers; else GREY and SMALL.
COLOURS = {"candidate": "#94a3b8", "decision": "#3b82f6", "preference": "#f59e0b", "constraint": "#ef4444", "lesson": "#8b5cf6", "fact": "#10b981", "correction": "#ec4899", "pattern": "#06b6d4"}
SIZES, GREY, SMALL = {"hot": 24, "warm": 16, "cold": 10}, "#6b7280", 8


def node_look(content: Column, category: Column, tier: Column, decay: Column) -> Column:
    """How a memory is drawn: label, colour, size, opacity."""
    of = lambda table, c, other: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), F.lit(other))
    label = F.when(F.length(content) > 60, F.concat(F.substring(content, 1, 60), F.lit("..."))).otherwise(content)
    return F.struct(label.alias("label"), of(COLOURS, category, GREY).alias("colour"), of(SIZES, tier, SMALL).alias("size"), (0.3 + 0.7 * decay).alias("opacity"))
