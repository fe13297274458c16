"""Template residue and error pages: text that stands in place of the content.

Lines of the documents are aligned by their skeleton (slots, values and numbers taken out). A skeleton whose slots
hold different names in different records, or that many documents share, is an induced template; a line of it is residue
where every slot keeps a variable name, a default or a blank. A line of any other skeleton with such slots is residue
where no real text stands beside it. A line that explains what a slot stands for is text. Filler, error pages and script
notices are whole lines of their own kind; filler is also a line of many words among which no function word is. A page
with an error or script line whose skeleton several documents share is a template of such pages, so that its other lines,
whatever their wording, are residue too. A document is a case when residue is its body: beside it there are only titles, page furniture and at most one opening
line before it.

Defined results
    * null, empty and blank texts are no case; a document comes out once, with the kind most of its residue lines have
      (ties: error_page, script_notice, filler, placeholder).
    * a line that also holds real values (field names, message codes) outside of its slots or quotation marks is no residue;
      in a line all in capitals nothing tells a name from a word.
    * documents with null ids are left out; ids given twice with different texts count by any text; empty tables give
      no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.session import cut, spread

#: Parts of a hot skeleton or page.
SALTS = 8
#: Marked slots: braces, brackets, percent, at, dunder, dollar, blanks, runs of X or question marks, to-do words.
SLOT = (
    r"\{\{[^{}\n]{0,60}\}\}|[$#]\{[^{}\n]{0,60}\}|\{%[^{}\n]{0,60}%\}|\{[\p{L}_. ]{1,40}\}|<<[^<>\n]{0,60}>>|<[\p{L}_. ]{1,40}>|\[\[[^\[\]\n]{0,60}\]\]|\[[\p{L}_. ]{1,40}\]"
    r"|%[\p{L}_.]{2,40}%|@@[\p{L}\p{N}_.]{1,40}@@|__[\p{L}][\p{L}\p{N}_.]{0,40}?__|\$[\p{L}_.]{2,40}\$|_{3,}|\?{3,}|(?<![A-Za-z])[Xx]{3,}(?![A-Za-z])|(?<![A-Za-z])(?:TODO|TBD|FIXME|TBA)(?![A-Za-z])"
)
#: Values that real records fill slots with: field names, message codes.
VALUE = r"\b\p{Lu}[\p{Lu}\p{N}]*(?:_[\p{Lu}\p{N}]+)+\b|\b\p{Lu}{2}\p{N}+\.\p{N}+"
QUOTE = "[\"“”„«»「」『』`]|(?<![\\p{L}])'|'(?![\\p{L}])"
#: Fixed wordings of filler in three languages.
FILLER = (
    r"(?i)^\W*(?:lorem ipsum|blindtext|(?:this is (?:a |some )?)?(?:dummy|sample|placeholder|filler) (?:copy|text|paragraph|content)|(?:your|insert|add|enter) (?:text|content) here|content (?:to follow|goes here|coming soon)"
    r"|(?:hier )?(?:steht|folgt|kommt)? ?(?:ihr |der |noch )?(?:beispiel|platzhalter|muster|blind)text\b|(?:der )?inhalt (?:folgt|wird)|text folgt|hier (?:steht|folgt|kommt|entsteht)|dies ist ein (?:platzhalter|blind|beispiel)"
    r"|此处填写|在此(?:输入|填写)|请(?:在此)?输入(?:内容|文本)|(?:示例|占位|测试|样例)(?:文本|文字|内容)|内容(?:待补充|待定|稍后)|待补充|敬请期待)"
)
REPEAT = r"(?i)^\W*([\p{L}]{2,10})(?:[\s,.]+\1){2,}\W*$|^\W*(?:([\p{L}]{3,5}) \2 )([\p{L}]{2,5}) \3\W*$|^\W*([\p{IsHan}]{2,6})\4{1,}\W*$"
STOP = r"(?iU)\b(?:the|of|a|an|is|are|in|and|to|for|by|with|on|at|der|die|das|und|den|dem|ist|wird|mit|von|auf|im|nach|bei)\b|[\p{N}\p{IsHan}]"
#: Fixed wordings of error pages in three languages.
ERROR = (
    r"(?i)(?:\b(?:error|fehler|http|status)\s*:?\s*[45]\d\d\b|^\W*[45]\d\d\b.{0,40}(?:not found|forbidden|unauthori[sz]ed|error|gateway|unavailable)|错误\s*[45]\d\d|\bpage (?:could not|cannot|can't) be|not be located on this server"
    r"|\baccess (?:is |was )?denied|do not have permission|not authori[sz]ed to|session (?:has |is )?(?:timed out|expired)|log ?in again|\bbad gateway|connection (?:has )?(?:timed out|reset|refused)|temporarily unavailable|try again later|service unavailable"
    r"|internal server error|something went wrong|an (?:unexpected )?error (?:has )?occurred|too many requests|rate limit exceeded|no longer exists|(?:page|file|resource) (?:was |is )?not found|under maintenance|\btraceback\b|stack trace|unhandled exception|connection (?:was |has been )?lost|was rolled back|could not be (?:loaded|rendered|displayed)|failed to (?:load|render|fetch)"
    r"|zugriff verweigert|keine berechtigung|sitzung (?:ist )?abgelaufen|(?:seite|datei).{0,30}nicht gefunden|(?:dienst|server|seite).{0,30}nicht erreichbar|erneut an(?:melden)?\b|melden sie sich erneut|versuchen sie es (?:später|erneut)|unbekannter fehler|fehler ist aufgetreten|zeitüberschreitung|zu viele anfragen|wartungsarbeiten|konnte nicht (?:geladen|angezeigt)|verbindung (?:wurde )?(?:getrennt|unterbrochen|verloren)"
    r"|没有权限|无权(?:访问|查看)|登录已过期|会话已(?:过期|超时)|重新登录|(?:页面|文件|资源)(?:不存在|未找到|无法找到)|不存在或已|暂时不可用|稍后(?:再试|重试)|系统(?:繁忙|错误|维护)|请求(?:未能|失败|超时|过多)|连接超时|服务器(?:错误|无响应)|加载失败|出错了)"
)
SCRIPT = r"(?i)(?:java ?script|\bscripts?\b|\bscripting\b|\bcookies\b|\bskripte?n?\b|脚本)"
CUE = rf"(?:{SLOT}|{FILLER}|{ERROR}|{SCRIPT}|{REPEAT})"
#: Wordings that explain a slot, in three languages.
MENTION = r"(?i)\b(?:stands? for|denotes?|notation|placeholders?|means|steht für|stehen für|bezeichnet|schreibweise|platzhalter)\b|表示|代表|占位符|写法"
#: So many documents with a skeleton make it a template, whatever its slots hold.
SHARED = 3
#: A line of at most so many characters without a sentence end is a title or page furniture.
TITLE = 60
OPENING = 400


def real_lines(text):
    """Lines that hold a real value outside of slots and are no title. Two of them rule residue out, as a document may have one
    opening line, and most documents are done with here; ``residue`` counts the same lines as real."""
    value = r"(?<![\p{L}\p{N}_{<\[$%@.])(?<![{<\[] )(?:\p{Lu}[\p{Lu}\p{N}]*_[\p{Lu}\p{N}]|\p{Lu}{2}\p{N}+\.\p{N})"
    return F.size(F.filter(F.split(text, r"\R"), lambda x: x.rlike(value) & x.rlike(r"\p{Ll}") & ~x.rlike(r"^[\s\p{Z}>]*(?:#|Ref\b)") & ((F.char_length(x) > 2 * TITLE) | x.rlike(r"[.!?。！？;；:：]\W*$"))))


def no_words(line):
    """Many words and no function word among them."""
    return line.rlike(r"\.$") & ~line.rlike(STOP) & (F.size(F.split(line, r"\s+")) >= 6) & ~line.rlike(SLOT)


def suspect_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line, kind, skeleton, slots): lines of the documents with any sign of residue in them."""
    texts = spread(docs.where("doc_id is not null and text is not null").select("doc_id", "text")).where(real_lines(F.col("text")) < 2)
    sign = F.col("text").rlike(f"{SLOT}|{SCRIPT}|{ERROR}") | F.col("text").rlike(r"(?m)" + FILLER) | F.col("text").rlike(r"(?m)" + REPEAT) | F.exists(F.split("text", r"\R"), no_words)
    lines = texts.where(sign).select("doc_id", F.posexplode(F.split("text", r"\R")).alias("pos", "raw")).select("doc_id", "pos", F.trim(F.regexp_replace("raw", r"^[\s\p{Z}>]+|[\s\p{Z}]+$", "")).alias("line")).where("line <> ''")
    line = F.col("line")
    capitals = ~line.rlike(r"\p{Ll}")
    plain = (~line.rlike(VALUE) | capitals) & ~line.rlike(QUOTE)
    filler = line.rlike(FILLER) & plain | line.rlike(REPEAT) | (line.rlike(r"(?i)^\W*(?:lorem|blindtext)\b") & plain) | (no_words(line) & plain)
    kind = (
        F.when(filler, "filler")
        .when(line.rlike(SLOT) & ~F.regexp_replace(line, SLOT, " ").rlike(VALUE), "placeholder")
        .when(line.rlike(SCRIPT) & plain, "script_notice")
        .when(line.rlike(ERROR) & plain, "error_page")
    )
    title = line.rlike(r"^#{1,6} ") | line.rlike(r"^Ref\b") | ((F.char_length(line) <= TITLE) & ~line.rlike(r"[.!?。！？;；:：]\W*$") & ~line.rlike(r"\|"))
    skeleton = F.regexp_replace(F.regexp_replace(line, SLOT, "\u0001"), r"\p{N}+", "#")
    slots = F.array_join(F.regexp_extract_all(line, F.lit(f"({SLOT})"), 1), "\u0001")
    return lines.select("doc_id", "pos", "line", kind.alias("sign"), title.alias("title"), line.rlike(MENTION).alias("mention"), F.xxhash64(skeleton).alias("skeleton"), F.xxhash64(slots).alias("fill"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))


def page_templates(lines: DataFrame) -> DataFrame:
    """(doc_id): documents with an error or script line whose whole page, titles apart, has a skeleton of at least SHARED
    documents. Pages are hashed per document and counted by hash before they are shuffled."""
    hashed = F.when(~F.col("title") | F.col("sign").isNotNull(), F.struct("pos", "skeleton"))
    page = lines.groupBy("doc_id").agg(F.xxhash64(F.transform(F.array_sort(F.collect_list(hashed)), lambda x: x["skeleton"])).alias("page"), F.max(F.coalesce(F.col("sign").isin("error_page", "script_notice"), F.lit(False))).alias("error"))
    page = page.where("error").select("doc_id", "page", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    shared = page.groupBy("page").count().where(f"count >= {SHARED}").select("page", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return page.join(shared, ["page", "salt"], "left_semi").select("doc_id")


def induced_templates(lines: DataFrame) -> DataFrame:
    """(skeleton): skeletons whose slots hold different names in different records, or that many documents share."""
    per = lines.where("sign = 'placeholder'").groupBy("skeleton", "fill", "doc_id").agg(F.max("mention").alias("mention")).groupBy("skeleton", "fill").agg(F.count("*").alias("n"), F.max("mention").alias("mention"))
    return per.groupBy("skeleton").agg(F.count("*").alias("fills"), F.sum("n").alias("n"), F.max("mention").alias("mention")).where(f"fills > 1 or (n >= {SHARED} and not mention)").select("skeleton")


def residue(docs: DataFrame) -> DataFrame:
    """(doc_id, kind): documents whose body is residue."""
    lines = cut(suspect_lines(docs))
    known = induced_templates(lines).select("skeleton", F.lit(True).alias("induced"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marked = lines.join(known, ["skeleton", "salt"], "left").join(page_templates(lines).withColumn("repeated", F.lit(True)), "doc_id", "left")
    sign = F.when(F.col("sign") == "placeholder", F.when(F.col("induced"), "placeholder")).otherwise(F.col("sign"))
    single = (F.col("sign") == "placeholder") & F.col("induced").isNull() & ~F.col("mention")
    flagged = marked.select("doc_id", "pos", "line", sign.alias("kind"), F.coalesce(single, F.lit(False)).alias("single"), (sign.isNull() & ~F.col("title") & F.col("repeated").isNull()).alias("real"))
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    per = flagged.groupBy("doc_id").agg(
        n("error_page"), n("script_notice"), n("filler"), n("placeholder"), F.count_if(F.col("real")).alias("real"), F.count_if("single").alias("single"), F.count_if(F.col("real") & F.col("single")).alias("real_single"),
        F.min(F.when(F.col("kind").isNotNull(), F.col("pos"))).alias("first"), F.max(F.when(F.col("real"), F.col("pos"))).alias("last_real"),
        F.coalesce(F.sum(F.when(F.col("real"), F.char_length("line"))), F.lit(0)).alias("real_chars"),
    )
    # Without other text beside them, lines of a skeleton seen once are residue too.
    alone = (F.col("single") > 0) & (F.col("real") == F.col("real_single"))
    per = per.withColumn("placeholder", F.col("placeholder") + F.when(alone, F.col("single")).otherwise(0)).withColumn("real", F.when(alone, 0).otherwise(F.col("real")))
    most = F.greatest("error_page", "script_notice", "filler", "placeholder")
    kind = F.when(F.col("error_page") == most, "error_page").when(F.col("script_notice") == most, "script_notice").when(F.col("filler") == most, "filler").otherwise("placeholder")
    body = (F.col("real") == 0) | ((F.col("real") == 1) & (F.col("last_real") < F.col("first")) & (F.col("real_chars") <= OPENING))
    return per.where((most > 0) & body).select("doc_id", kind.alias("kind"))


def without_residue(docs: DataFrame) -> DataFrame:
    """The documents that are no case; rows with a null id are kept."""
    return docs.join(residue(docs).select("doc_id"), "doc_id", "left_anti")
