"""Records that hold template residue, filler, error messages or script notices instead of, or amid, real content.

Lines with evidence are normalised (case, digits, hexadecimal ids, white space) and counted by host over distinct bodies, a body
being what a record holds beside its evidence: copies of a page count once. A line with evidence that recurs beside bodies of their own,
that is, mostly of lines that do not recur, is boilerplate of the host; it is subtracted from records that hold a line which
does not recur, never from others. So copies of one bad page, exact or near, stay cases. A record is excluded if what is left
of it holds evidence:

* error        a message that stands as a line of its own: of known wording, or a short line full of words of servers and browsers;
* script       a notice that scripts are required, as a line of its own;
* placeholder  a template variable or blank that was not filled, anywhere;
* filler       dummy text, dummy letters, or one sentence again and again.

What stands between quotation marks is quoted, and a sentence that speaks of an error or of scripts is no message, so neither
is evidence.

Defined results: null, empty and blank texts hold no evidence; a null host is a host of its own; repeated rows count once for
the evidence; empty tables give an empty result; extra columns are ignored.

Scale: evidence is found line by line in one pass over the texts, which keeps a hash for each line; subtracting boilerplate
means looking up the few lines with evidence. Hashes of lines are shuffled by record and by line; a hot host is many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fondaco.session import materialise

#: A line beside this share of a host's distinct bodies, and beside so many at least, recurs.
SHARE, LEAST = 0.05, 20
#: A body is a record's own if the lines that do not recur hold this share of the record's characters.
OWN = 1 / 3

# Wording of messages, notices and dummy text in the languages of the corpus.
STATUS = (
    "not found|forbidden|bad request|unauthorized|internal server error|bad gateway|service unavailable|gateway timeout|request timeout|"
    "too many requests|method not allowed|gone|conflict|payload too large|not implemented"
)
ERROR_LINES = [
    r"(?:oops!?|ops!?)\s",
    r"(?:errore?|error|fehler|erreur)\s*(?:http\s*)?\d{3}\b",
    r"(?:errore|error|fehler|erreur|fatal|exception|warning)\s*:",
    rf"(?:http(?:/\d(?:\.\d)?)?\s+)?[45]\d\d\s*[-:–]?\s*(?:{STATUS})\b",
    r"http(?:/\d(?:\.\d)?)?\s+[45]\d\d\s*$",
    r"id richiesta\s*:",
    rf"(?:<[a-z][^>]*>\s*){{1,9}}(?:[45]\d\d\s*)?(?:{STATUS})\b",
    r"\{\s*\"?(?:errors?|status|code|message)\"?\s*:",
    r"traceback \(most recent call last\)",
    r"\w+(?:error|exception): ",
    r"(?:si è|è stato) (?:verificato|riscontrato) un errore\b",
    r"la pagina (?:richiesta|cercata) non (?:è stata trovata|esiste)",
    r"pagina non trovata",
    r"page (?:not found|introuvable)",
    r"seite nicht gefunden",
    r"(?:il )?servizio (?:è )?(?:temporaneamente|momentaneamente) non (?:è )?disponibile",
    r"service temporarily unavailable",
    r"sessione scaduta[,.:]",
    r"(?:session expired|your session has expired|votre session a expiré|ihre sitzung ist abgelaufen)",
    r"troppe richieste",
    r"impossibile (?:completare la richiesta|caricare|visualizzare la pagina)",
    r"accesso negato",
    r"(?:access denied|accès refusé|zugriff verweigert)",
    r"(?:documento|contenuto) non (?:è )?disponibile",
    r"manutenzione programmata",
    r"sito in manutenzione",
]
SCRIPT_LINES = [
    r"<noscript",
    r"please (?:enable|turn on|activate) (?:javascript|scripts)",
    r"you need to enable (?:javascript|scripts)",
    r"(?:this (?:page|site|app) requires|enable) (?:javascript|scripts)",
    r"(?:per|al fine di) (?:visualizzare|continuare|proseguire|usare|leggere)[^.]{0,60}(?:abilitare|attivare) (?:javascript|gli script)",
    r"(?:abilitare|attivare|abilita|attiva) (?:javascript|gli script)",
    r"javascript (?:risulta |è )?(?:disattivato|disabilitato|necessario|richiesto|is (?:disabled|required))",
    r"stiamo verificando il (?:tuo )?browser",
    r"questo sito richiede (?:gli script|javascript)",
    r"checking your browser",
    r"bitte aktivieren sie (?:javascript|skripte)",
    r"veuillez activer (?:javascript|les scripts)",
]
VARIABLE = r"[\p{L}_][\p{L}\p{N}_.]*"
PLACEHOLDERS = [
    r"\{\{+\s*[^{}\n]{1,60}\}?", rf"[$#]\{{\s*{VARIABLE}", rf"\$\(\s*{VARIABLE}\s*\)", rf"<%=?\s*{VARIABLE}", rf"\{{%\s*{VARIABLE}", rf"\{{{VARIABLE}\}}",
    rf"\[\[\s*{VARIABLE}", r"\[\s*(?:INSERIRE|inserire|Inserire|INSERT|insert|TODO|FIXME|XXX)\b", r"\[[^\[\]\n]{1,60} da (?:completare|inserire|definire|compilare)\]",
    r"(?<!\p{L})DA (?:COMPLETARE|INSERIRE|DEFINIRE|COMPILARE)(?!\p{L})", r"(?<!\p{L})(?:gg|GG|dd|DD)/(?:mm|MM)/(?:a{2,4}|A{2,4}|y{2,4}|Y{2,4})(?!\p{L})", rf"##{VARIABLE}##", rf"@@{VARIABLE}@@", rf"%%{VARIABLE}%%", r"(?<![\p{L}\p{N}_])__[\p{L}][\p{L}\p{N}_.]*__", r"(?<![\p{L}\p{N}%])%[sd](?![\p{L}\p{N}])",
    r"_{3,}", r"€ ?\.{4,}", r"(?<!\.)\.{6,}", r"(?<![\p{L}\p{N}])X{3,}/\d{0,2}X", r"(?<![\p{L}\p{N}])XX/XX/\d{0,2}XX", r"(?:^|[\s(\[])(?:TODO|FIXME|TBD)(?:[\s:.,;)\]]|$)",
    rf"\[(?!(?:omissis|sic|ndr|nda|NDR|OMISSIS)\]){VARIABLE}\]", rf"(?<!<)<(?!/|omissis|OMISSIS|noscript|(?:a|b|i|u|p|br|hr|em|h[1-6]|li|ul|ol|td|tr|div|sub|sup|span|strong|table)\b){VARIABLE}(?: {VARIABLE})?>",
    rf"&(?!(?:amp|lt|gt|quot|apos|nbsp|laquo|raquo|euro|sect|deg|hellip|[mn]dash|[aeiouAEIOU](?:grave|acute|circ|uml)|ccedil|szlig|#?\p{{N}}+);){VARIABLE};",
]
DUMMY_WORDS = (
    "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|enim|ad|minim|veniam|quis|"
    "nostrud|exercitation|ullamco|laboris|nisi|aliquip|ex|ea|commodo|consequat"
)
FILLERS = [
    rf"(?:(?<![\p{{L}}\p{{N}}])(?:{DUMMY_WORDS})[\s,.;]+){{5}}",
    r"(?:(?<![\p{L}\p{N}])x{2,}[\s,.;]+){4}",
    r"(?:(?<![\p{L}\p{N}])(?:foo|bar|bla|test|prova|blah)[\s,.;]+){4}",
    r"(?:(?<![\p{L}\p{N}])(?:asdf|qwert[yz])[\s,.;]+){2}",
    r"(?:inserire|scrivere|incollare) qui il ",
    r"testo (?:segnaposto|di prova|provvisorio|non ancora disponibile)",
    r"contenuto (?:provvisorio|mancante|in preparazione|in arrivo)",
    r"da sostituire prima della pubblicazione",
    r"(?:placeholder|dummy) text",
]

#: Words of servers and browsers, which legal prose has no use for. A short line that holds several is a message, whatever its wording.
SERVICE = r"\b(?:servers?|browsers?|javascript|cookies?|cache|login|log-?in|urls?|https?|timeout|prox(?:y|ies)|dns|gateway|captcha|redirect(?:ion)?|plugins?|refresh|reload|webmasters?|homepage|firewall|cloudflare|nginx|apache|iis|cdn|ssl|tls|localhost|database|backend|api)\b"
#: A line of at most so many characters, with so many different words of SERVICE, of which one stands in so many words.
SHORT_LINE, SEVERAL, EVERY = 200, 2, 8

QUOTED = "«[^»\n]*»|“[^”\n]*”|„[^“\n]*“|<<[^<>\n]*>>"


def _any(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def line_key(line: Column) -> Column:
    """The line without what differs from page to page: case, digits, hexadecimal ids, white space."""
    line = F.regexp_replace(F.lower(line), r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b", "#")
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"\d+", "#"), r"[\s ​]+", " "))


#: One word three times in a row.
ONE_WORD = r"(?iu)(?<![\p{L}\p{N}])(\p{L}{3,}+)(?:\s+\1){2}(?![\p{L}\p{N}])"
#: What a line must hold for the costly patterns to be tried on it; what begins with a letter stands at the start of a word.
MAY_HOLD_PLACEHOLDER = r"[{\[<$#@%_&€]|\.{6}|\b(?:X[X/]|T(?:ODO|BD)|FIXME|DA [CDI]|[mM][mM]/[aAyY])"
MAY_BE_FILLER = (
    r"\b(?:i(?:psum|n (?:preparazione|arrivo))|d(?:olor|isponibile|ummy|a (?:sostituire|completare|inserire|definire))|lorem|veniam|nostrud|xx|asdf|qwert|foo|b(?:lah?|ar)\b|"
    r"test\b|p(?:rov(?:a|visori)|laceholder)|qui il |segnaposto|mancante)"
)


def evidence(said: Column, low: Column) -> Column:
    """Kind of evidence in a line freed of quotations, also given in lower case; null if none."""
    start = r"(?iu)^[\s\u00a0\u200b•*>\-]*"
    sentences = F.filter(F.split(low, r"(?<=[.!?])\s+"), lambda s: F.length(s) >= 8)
    # One sentence three times in a row, or more; sentences cut at abbreviations recur, but not in a row.
    repeated = F.size(F.filter(F.zip_with(sentences, F.slice(sentences, F.lit(2), F.size(sentences)), lambda x, y: x == y), lambda same: same)) >= 2
    repeated = low.rlike(r"(?s)[.!?]\s.*[.!?]\s") & repeated  # three sentences at least
    served = F.array_distinct(F.regexp_extract_all(low, F.lit(SERVICE), F.lit(0)))
    service = (F.length(said) <= SHORT_LINE) & low.rlike(SERVICE) & (F.size(served) >= SEVERAL) & (F.size(served) * EVERY >= F.size(F.split(F.trim(low), r"\s+")))
    return (
        F.when(said.rlike(start + _any(ERROR_LINES)), "error")
        .when(said.rlike(start + _any(SCRIPT_LINES)), "script")
        .when(said.rlike(MAY_HOLD_PLACEHOLDER) & said.rlike(_any(PLACEHOLDERS)), "placeholder")
        .when(service, "error")
        .when(said.rlike(ONE_WORD), "filler")
        .when((low.rlike(MAY_BE_FILLER) & F.concat(said, F.lit(" ")).rlike("(?iu)" + _any(FILLERS))) | repeated, "filler")
    )


def marked_lines(documents: DataFrame, id_column: str, text_column: str, host: str) -> DataFrame:
    """(id, host, key, chars, kind): each line of each record by a hash, of its normal form if it has evidence. One pass over the texts."""
    texts = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text_column).alias("text"))
    lines = texts.where("text is not null and id is not null").select("id", "host", F.explode(F.split("text", r"[\r\n]+")).alias("line"))
    lines = lines.where(F.length(F.trim("line")) > 0)
    # Each step is named and used several times after, so the optimiser leaves it a step of its own.
    said = F.when(F.col("line").rlike("[«“„]|<<"), F.regexp_replace("line", QUOTED, " ")).otherwise(F.col("line"))
    lines = lines.select("id", "host", "line", said.alias("said")).select("*", F.lower("said").alias("low")).select("id", "host", "line", evidence(F.col("said"), F.col("low")).alias("kind"))
    key = F.when(F.col("kind").isNull(), F.xxhash64(F.trim("line"))).otherwise(F.xxhash64(line_key(F.col("line"))))
    return lines.select("id", "host", key.alias("key"), F.length("line").alias("chars"), "kind")


def with_bodies(marked: DataFrame) -> DataFrame:
    """(id, host, key, chars, kind, body, of): the distinct lines of each record; body is a hash of its lines without evidence, null if it has none."""
    lines = marked.groupBy("host", "id", "key").agg(F.max("chars").alias("chars"), F.max("kind").alias("kind"))
    bodies = lines.groupBy("host", "id").agg(F.bit_xor(F.when(F.col("kind").isNull(), F.xxhash64("key"))).alias("body"), F.sum("chars").alias("of"))
    return lines.join(bodies, ["host", "id"])


def recurrent(lines: DataFrame, bodies: DataFrame) -> DataFrame:
    """(host, key) of the lines that stand beside the least number and share of a host's distinct bodies."""
    totals = bodies.where("body is not null").select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("total"))
    counts = lines.where("body is not null").select("host", "key", "body").distinct().groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    return counts.join(totals, "host").where(F.col("n") >= SHARE * F.col("total")).select("host", "key")


def subtracted(marked: DataFrame) -> DataFrame:
    """(host, id, key): evidence that is boilerplate of the host, in records that hold other content."""
    lines = materialise(with_bodies(marked), "bodies")
    own = lines.where("kind is null").join(recurrent(lines.where("kind is null"), lines), ["host", "key"], "left_anti")
    own = own.groupBy("host", "id").agg((F.sum("chars") >= OWN * F.first("of")).alias("full"))
    told = lines.where("kind is not null").join(own, ["host", "id"])
    return told.join(recurrent(told.where("full"), lines), ["host", "key"]).select("host", "id", "key")


def residue(documents: DataFrame, id_column: str, text_column: str, host: str) -> DataFrame:
    """(id, kinds): the records to exclude, with the kinds of evidence in what is left of them."""
    marked = materialise(marked_lines(documents, id_column, text_column, host), "lines")
    left = marked.where("kind is not null").join(subtracted(marked), ["host", "id", "key"], "left_anti")
    return left.groupBy("id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
