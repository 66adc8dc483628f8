"""The registered queries of the mail engine and their SQL oracles.

The tables hold no mail, so each query makes mails from columns, runs the engine over
them, and its oracle says from the same columns what has to come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import columns as C
from postmill.operators import messages as M
from postmill.operators import notes as N
from postmill.plans.convert import Options, convert
from postmill.plans.mailbox import base64, header, lines, mail, multipart, order_mails, part, quoted_printable, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


# Notes of plain mails

_NOTE = r"""
    '---' || chr(10) || 'created: ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M') || chr(10)
    || 'from: "' || c_name || ' <c' || c_custkey || '@example.com>"' || chr(10) || 'to: "desk@example.com"' || chr(10) || 'cc:' || chr(10)
    || 'via:' || chr(10) || 'subject: "Order ' || o_orderkey || ': \"' || o_orderpriority || '\""' || chr(10) || 'attachments:' || chr(10)
    || '---' || chr(10) || chr(10) || 'Status ' || o_orderstatus || chr(10)"""
_NOTES = f"select o_orderkey::varchar as mail_id, {_NOTE} as markdown from orders join customer on o_custkey = c_custkey"


@query(_NOTES)
def note_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-part mails as notes, in Spark's expressions alone."""
    raw = F.decode("content", "UTF-8")
    parsed = order_mails(spark, sf_dir).select("mail_id", C.headers(raw).alias("h"), C.body_block(raw).alias("raw_body"))
    name, address = (F.regexp_extract(F.col("h")["from"], r'^"?(.*?)"? <([^<>]*)>$', k) for k in (1, 2))
    messages = parsed.select(
        "mail_id", C.mailbox(name, address).alias("from"), F.col("h")["to"].alias("to"), F.lit(None).cast("string").alias("cc"), F.col("h")["subject"].alias("subject"),
        C.instant(F.col("h")["date"]).alias("created"), F.btrim(C.collapse_blank_lines(C.strip_line_ends("raw_body")), F.lit(" \n")).alias("body"),
        F.array().cast("array<struct<name:string,media_type:string,source_name:string,is_embedded:boolean>>").alias("attachments"),
    )
    return N.render(messages).select("mail_id", "markdown")


@query(_NOTES)
def note_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mails through the whole conversion."""
    return convert(order_mails(spark, sf_dir).select("mail_id", "content")).select("mail_id", "markdown")


@query("""
    select o_orderkey::varchar as mail_id, 'Order ' || o_orderkey || ' of ' || o_orderpriority as subject, o_orderstatus as last
    from orders""")
def folded_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded and repeated headers."""
    orders = table(spark, sf_dir, "orders")
    subject = F.concat(F.lit("Subject:\r\n Order "), F.col("o_orderkey").cast("string"), F.lit("\r\n\t of  \r\n  "), F.col("o_orderpriority"))
    raw = F.concat(lines(subject, "X-State: first", header("x-STATE", F.col("o_orderstatus")), ""), F.lit("\r\nbody"))
    done = M.parse(mail(orders, "o_orderkey", raw).select("mail_id", "content"))
    return done.select("mail_id", "subject", F.col("headers")["x-state"].alias("last"))


@query("""
    select o_orderkey::varchar as mail_id, 'Order ' || o_orderkey as subject, o_orderstatus as last, '' as body from orders""")
def header_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers as a map, in Spark's expressions alone; a mail without an empty line is all header."""
    orders = table(spark, sf_dir, "orders")
    raw = lines(F.concat(F.lit("Subject: Order\r\n  "), F.col("o_orderkey").cast("string")), "X-State: first", header("x-STATE", F.col("o_orderstatus")))
    found = orders.select(F.col("o_orderkey").cast("string").alias("mail_id"), C.headers(raw).alias("h"), C.body_block(raw).alias("body"))
    return found.select("mail_id", F.col("h")["subject"].alias("subject"), F.col("h")["x-state"].alias("last"), "body")


# Addresses and dates


@query("""
    select c_custkey::varchar as mail_id,
        case c_custkey % 6
            when 0 then c_name || ' <c' || c_custkey || '@example.com>'
            when 1 then c_name || ' <c' || c_custkey || '@example.com>'
            when 2 then 'c' || c_custkey || '@example.com'
            when 3 then '"' || c_name || ', Ärger" <c' || c_custkey || '@example.com>, d@example.com'
            when 4 then 'c' || c_custkey || '@example.com'
            else 'Undisclosed recipients: ;' end as "from"
    from customer""")
def address_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six spellings of address headers."""
    customer = table(spark, sf_dir, "customer")
    kind, name = F.col("c_custkey") % 6, F.col("c_name")
    address = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    encoded = F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(F.concat(name, F.lit(", Ärger")), "UTF-8")), F.lit("?="))
    shown = (
        F.when(kind == 0, F.concat(F.lit('"'), name, F.lit('" <'), address, F.lit(">")))
        .when(kind == 1, F.concat(name, F.lit("   <"), address, F.lit("> , ")))
        .when(kind == 2, F.concat(F.lit("'"), F.upper(address), F.lit("' <"), address, F.lit(">")))
        .when(kind == 3, F.concat(encoded, F.lit(" <"), address, F.lit(">, d@example.com")))
        .when(kind == 4, F.concat(F.lit("<"), address, F.lit(">")))
        .otherwise(F.lit("Undisclosed recipients: ;"))
    )
    raw = F.concat(lines(header("From", shown), ""), F.lit("\r\nx"))
    return M.parse(mail(customer, "c_custkey", raw).select("mail_id", "content")).select("mail_id", "from")


@query("""
    select o_orderkey::varchar as mail_id,
        case when o_orderkey % 9 = 8 then null
             when o_orderkey % 9 in (3, 4) then date_trunc('minute', o_orderdate) else date_trunc('second', o_orderdate) end as created,
        case o_orderkey % 9 when 1 then 120 when 6 then -300 when 8 then null else 0 end::integer as sender_offset_min
    from orders""")
def date_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine spellings of the Date header; the last one is no date."""
    orders, kind, at = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 9, F.col("o_orderdate")
    form = lambda f, shift=0: F.date_format(at + F.expr(f"interval {shift} hours"), f)
    shown = (
        F.when(kind == 0, F.concat(form("E"), F.lit(", "), form("dd MMM yyyy HH:mm:ss '+0000'")))
        .when(kind == 1, form("dd MMM yyyy HH:mm:ss '+0200'", 2))
        .when(kind == 2, form("d MMM yyyy HH:mm:ss '+0000 (UTC)'"))
        .when(kind == 3, form("dd MMM yyyy HH:mm '+0000'"))
        .when(kind == 4, F.concat(form("E"), F.lit(", "), form("d MMM yyyy HH:mm 'GMT'")))
        .when(kind == 5, form("dd MMM yyyy  HH:mm:ss 'UT'"))
        .when(kind == 6, form("dd MMM yyyy HH:mm:ss 'est'", -5))
        .when(kind == 7, F.concat(F.lit("(x) "), form("dd MMM yyyy HH:mm:ss '-0000'")))
        .otherwise(F.lit("yesterday"))
    )
    raw = F.concat(lines(header("Date", shown), ""), F.lit("\r\nx"))
    done = M.parse(mail(orders, "o_orderkey", raw).select("mail_id", "content"))
    return done.select("mail_id", F.col("created").cast("timestamp_ntz").alias("created"), "sender_offset_min")


# Transfer encodings and charsets

_CLEAN = r"trim(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), ' ' || chr(10) || chr(9) || chr(13))"


def _document_bodies(spark, sf_dir, *headers, body, condition="true"):
    documents = table(spark, sf_dir, "documents").where(condition)
    raw = F.concat(lines(*headers, ""), F.lit("\r\n"), body(F.col("text")))
    return M.parse(mail(documents, "doc_id", raw).select("mail_id", "content")).select("mail_id", "body")


@query(f"select doc_id::varchar as mail_id, {_CLEAN} as body from documents")
def base64_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_bodies(spark, sf_dir, "Content-Type: text/plain; charset=UTF-8", "Content-Transfer-Encoding: BASE64 ", body=base64)


@query(f"select doc_id::varchar as mail_id, {_CLEAN} as body from documents")
def qp_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_bodies(spark, sf_dir, "content-type: text/plain; charset=utf-8", "Content-Transfer-Encoding: quoted-printable", body=quoted_printable)


@query("select doc_id::varchar as mail_id, text as body from documents")
def base64_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base64 in Spark's expressions alone; what is no base64 stays."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("mail_id"), base64(F.col("text")).alias("b"))
    return documents.select("mail_id", C.base64_text("b").alias("body"))


@query("""
    select doc_id::varchar as mail_id, trim(left(text, 12), ' ' || chr(10)) || '/' || lang as subject from documents""")
def encoded_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent encoded words, in both encodings."""
    documents = table(spark, sf_dir, "documents")
    start = F.btrim(F.substring("text", 1, 12), F.lit(" \n"))
    q = F.regexp_replace(F.hex(F.encode(F.concat(F.lit("/"), F.col("lang")), "UTF-8")), "(..)", "=$1")
    value = F.concat(F.lit("=?UTF-8?b?"), F.base64(F.encode(start, "UTF-8")), F.lit("?=\r\n =?utf-8?Q?"), q, F.lit("?="))
    raw = F.concat(lines(header("Subject", value), ""), F.lit("\r\nx"))
    return M.parse(mail(documents, "doc_id", raw).select("mail_id", "content")).select("mail_id", "subject")


_LATIN = r"lang in ('de', 'fr', 'es') and regexp_matches(text, '[\x{80}-\x{FF}]') and not regexp_matches(text, '[^\x00-\x7F\x{A0}-\x{FF}]')"


@query(f"select doc_id::varchar as mail_id, {_CLEAN} as body, 'latin-1' as charset from documents where {_LATIN}")
def latin1_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails that are no UTF-8, read in the charset they declare."""
    documents = table(spark, sf_dir, "documents").where("lang in ('de', 'fr', 'es')")
    documents = documents.where(F.col("text").rlike("[\\x80-\\xff]") & ~F.col("text").rlike("[^\\x00-\\x7f\\xa0-\\xff]"))
    raw = F.concat(lines("Content-Type: text/plain; charset=iso-8859-1", "Content-Transfer-Encoding: 8bit", ""), F.lit("\r\n"), F.col("text"))
    mails = documents.select(F.col("doc_id").cast("string").alias("mail_id"), F.encode(raw, "ISO-8859-1").alias("content"))
    return M.parse(mails).select("mail_id", "body", "charset")


@query("""
    select i::varchar as mail_id,
        case when i between 128 and 159 and i not in (129, 141, 143, 144, 157)
             then chr((['8364','0','8218','402','8222','8230','8224','8225','710','8240','352','8249','338','0','381','0','0','8216','8217','8220','8221','8226','8211','8212','732','8482','353','8250','339','0','382','376'])[i - 127]::integer)
             else chr(i::integer) end as character
    from range(1, 256) t(i)""")
def windows_1252(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte but 0 as windows-1252."""
    rows = spark.range(1, 256).select(F.col("id").cast("string").alias("mail_id"), F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("b"))
    return rows.select("mail_id", C.windows_1252("b").alias("character"))


@query("""
    select conv_id::varchar as mail_id, case when conv_id % 3 = 0 then null when conv_id % 3 = 1 then 'iso-8859-1' else 'koi8-r' end as charset
    from conversations group by conv_id""")
def charset_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first charset declared that can stand for bytes beyond ASCII."""
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    second = F.element_at(F.array(F.lit("us-ascii"), F.lit("ISO-8859-1"), F.lit("koi8-r")), (F.col("conv_id") % 3 + 1).cast("int"))
    raw = multipart("mixed", F.array(part("text/plain; charset=utf-8", "a"), part(F.concat(F.lit("text/plain; charset="), second), "b"), part("text/plain; charset=UTF-8", "c")))
    return M.fallback_charsets(M.parts(mail(chats, "conv_id", raw).select("mail_id", "content")))


# The MIME tree


def _turns(spark, sf_dir):
    turn = F.struct("turn", "role", "text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


@query(f"""
    select conv_id::varchar as mail_id, max_by({_CLEAN}, turn) as body
    from conversations group by conv_id""")
def alternative_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a multipart/alternative the last form that shows something."""
    forms = F.transform("turns", lambda t: part("text/plain; charset=utf-8", base64(t["text"]), "Content-Transfer-Encoding: base64"))
    blank = F.array(part("text/plain", "  \r\n"), part("text/html", "<div><!-- nothing --></div>"))
    raw = multipart("alternative", F.concat(forms, blank))
    return M.parse(mail(_turns(spark, sf_dir), "conv_id", raw).select("mail_id", "content")).select("mail_id", "body")


@query(f"""
    select conv_id::varchar as mail_id,
        trim(string_agg(regexp_replace(trim(text, chr(10)), '[ \t]+(\n|$)', '\\1', 'g'), chr(10) || chr(10) order by turn), ' ' || chr(10)) as body
    from conversations group by conv_id""")
def mixed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of a multipart/mixed in order, files between them left out."""
    texts = F.transform("turns", lambda t: F.array(part("text/plain; charset=utf-8", base64(F.btrim(t["text"], F.lit("\n"))), "Content-Transfer-Encoding: base64"), part("text/plain", "file", "Content-Disposition: attachment; filename=a.txt")))
    raw = multipart("mixed", F.flatten(texts))
    return M.parse(mail(_turns(spark, sf_dir), "conv_id", raw).select("mail_id", "content")).select("mail_id", "body")


@query("""
    select conv_id::varchar as mail_id, count(*)::bigint + 2 as n_parts, count(*)::bigint as n_turns, 2::bigint as deepest
    from conversations group by conv_id""")
def parts_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested container, flattened with its paths."""
    inner = F.transform("turns", lambda t: part("text/plain", "x", header("X-Role", t["role"])))
    nested = F.concat(F.lit('Content-Type: multipart/related; boundary="b2"\r\n\r\n--b2\r\n'), F.array_join(inner, "\r\n--b2\r\n"), F.lit("\r\n--b2--\r\n"))
    rows = M.parts(mail(_turns(spark, sf_dir), "conv_id", multipart("mixed", F.array(nested))).select("mail_id", "content"))
    return rows.groupBy("mail_id").agg(
        F.count("*").alias("n_parts"), F.count_if(F.col("part.headers")["x-role"].isNotNull()).alias("n_turns"), F.max(F.size("part.path")).cast("long").alias("deepest")
    )


# Attachments and pictures


def _part_mails(spark, sf_dir):
    """A mail for each 10 parts of the catalogue: text, files of several kinds, text."""
    parts = table(spark, sf_dir, "part").withColumn("box", F.floor(F.col("p_partkey") / 10).cast("long"))
    kind = F.col("p_partkey") % 5
    name = F.concat(F.lit("p"), F.col("p_size").cast("string"), F.lit(".pdf"))
    one = (
        F.when(kind == 0, part("application/pdf", "x", header("Content-Disposition", F.concat(F.lit('attachment; filename="'), name, F.lit('"')))))
        .when(kind == 1, part(F.concat(F.lit("application/pdf; name="), name), "x", "Content-Disposition: inline"))
        .when(kind == 2, part(F.concat(F.lit('image/png; name="s'), F.col("p_partkey").cast("string"), F.lit('.png"')), "x", "Content-Disposition: inline"))
        .when(kind == 3, part('application/pkcs7-signature; name="smime.p7s"', "x", "Content-Disposition: attachment; filename=smime.p7s"))
        .otherwise(part(F.concat(F.lit("image/gif; name=c"), F.col("p_partkey").cast("string"), F.lit(".gif")), "x", header("Content-ID", F.concat(F.lit("<i"), F.col("p_partkey").cast("string"), F.lit("@example.com>")))))
    )
    files = parts.groupBy("box").agg(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("one")))).alias("rows"))
    inside = F.transform("rows", lambda r: r["one"])
    return mail(files, "box", multipart("mixed", F.concat(F.array(part("text/plain", "before")), inside, F.array(part("text/plain", "after")))))


_FILES = """
    select (p_partkey // 10)::bigint::varchar as mail_id,
        case p_partkey % 5 when 2 then 's' || p_partkey || '.png' else 'p' || p_size || '.pdf' end as filename, p_partkey
    from part where p_partkey % 5 in (0, 1, 2)"""


@query(f"select mail_id, string_agg(filename, '|' order by p_partkey) as names from ({_FILES}) group by mail_id")
def attachments_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attached, inline and between-text files; signatures and pictures of the HTML are none."""
    done = M.parse(_part_mails(spark, sf_dir).select("mail_id", "content"))
    return done.select("mail_id", F.array_join(F.transform("attachments", lambda a: a["name"]), "|").alias("names"))


@query(f"select mail_id, filename from ({_FILES})")
def attachment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a relation: a filter of parts and a window for what stands between texts."""
    rows = M.parts(_part_mails(spark, sf_dir).select("mail_id", "content"))
    return M.attachments(rows).select("mail_id", F.col("part.filename").alias("filename"))


def _letters(spark, sf_dir):
    """A mail for each part: HTML that shows pictures i0, i1, i1 and i2; i0 is attached, i1 and i2 are parts, i1 twice."""
    parts = table(spark, sf_dir, "part")
    html = F.concat(
        F.lit("<p>"), F.col("p_brand"), F.lit(' <img src="cid:i0"><img src="CID:i%31" width="'), F.col("p_size").cast("string"), F.lit('"><img src="cid:i1"><b><img src="cid:i2" style="height:30pt" alt="'), F.col("p_type"), F.lit('"></b></p>')
    )
    png = F.lit("iVBORw0KGgoAAAANSUhEUgAAAFAAAAAoCAYAAABpYH0BAAAA")  # the header of a picture of 80 by 40
    picture = lambda i, n, *more: part(f"image/png; name={n}", png, f"Content-ID: <{i}>", "Content-Transfer-Encoding: base64", *more)
    raw = multipart("related", F.array(part("text/html; charset=utf-8", html), picture("i0", "a.png", "Content-Disposition: attachment"), picture("i1", "b.png"), picture("i1", "c.png"), picture("i2", "d.png")))
    return mail(parts, "p_partkey", raw).select("mail_id", "content")


@query("""
    select p_partkey::varchar as mail_id, unnest(['i1', 'i2']) as content_id, unnest(['b.png', 'd.png']) as filename,
        unnest([p_size::integer, null]) as width, unnest([null, 40])::integer as height
    from part""")
def cid_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures shown joined with their parts, without those that are attached."""
    mails = _letters(spark, sf_dir)
    shown = M.parse(mails).select("mail_id", F.posexplode("pictures").alias("shown", "p")).select("mail_id", "shown", "p.*")
    found = M.pictures_with_parts(shown, M.parts(mails))
    return found.select("mail_id", "content_id", F.col("part.filename").alias("filename"), "width", "height")


@query("""
    select p_partkey::varchar as mail_id,
        'inline images left out: b.png ' || p_size || '×' || floor(p_size / 2.0 + 0.5)::integer || ', d.png 80×40' as omitted
    from part""")
def omitted_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures a note leaves out, an open side in proportion to the file's."""
    return N.omissions(M.parse(_letters(spark, sf_dir))).select("mail_id", "omitted")


@query(r"""
    select p_partkey::varchar as mail_id,
        '---' || chr(10) || 'created:' || chr(10) || 'from:' || chr(10) || 'to:' || chr(10) || 'cc:' || chr(10) || 'via:' || chr(10) || 'subject:' || chr(10)
        || 'attachments:' || chr(10) || '  - "[[a.png]]"' || chr(10) || '  - "[[b.png]]"' || chr(10) || '  - "[[d.png]]"' || chr(10) || '---' || chr(10) || chr(10)
        || p_brand || ' ![[a.png]]![[b.png]]![[b.png]]![[d.png|' || p_type || ']]' || chr(10) as markdown
    from part""")
def embedded_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with their pictures written and embedded where the HTML shows them."""
    return convert(_letters(spark, sf_dir), Options(pictures=True)).select("mail_id", "markdown")


@query("""
    select (p_partkey // 2)::bigint::varchar as mail_id,
        string_agg(case p_partkey % 2 when 0 then 'Ä_' || p_size || ' p' || p_partkey || ';x.pdf' else 'ä ' || p_partkey || '.png' end, '|' order by p_partkey) as names
    from part group by p_partkey // 2""")
def continued_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names in sections that come in any order, with escaped bytes of a charset, and a semicolon in quotes."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    sections = F.concat(F.lit("attachment;\r\n filename*1=\" p"), key, F.lit(";x.pdf\"; filename*0*=utf-8''%C3%84_"), size)
    one = F.when(F.col("p_partkey") % 2 == 0, part("application/pdf", "x", header("Content-Disposition", sections))).otherwise(
        part(F.concat(F.lit("image/png; name*=iso-8859-1'de'%E4%20"), key, F.lit(".png")), "x", "Content-Disposition: attachment")
    )
    mails = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 2).cast("long").alias("k")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("one")))).alias("rows"))
    done = M.parse(mail(mails, "k", multipart("mixed", F.transform("rows", lambda r: r["one"]))).select("mail_id", "content"))
    return done.select("mail_id", F.array_join(F.transform("attachments", lambda a: a["name"]), "|").alias("names"))


@query("select doc_id::varchar as mail_id, 'f' || (doc_id % 3) || '.txt' as name, octet_length(encode(text))::bigint as size, sha256(text) as digest from documents where text is not null and not contains(text, chr(13))")
def file_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of attached files, in base64, quoted-printable and as they are."""
    documents = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & ~F.col("text").contains("\r"))
    kind, text = F.col("doc_id") % 3, F.col("text")
    named = F.concat(F.lit('attachment; filename="f'), kind.cast("string"), F.lit('.txt"'))
    file = lambda body, *more: part("text/plain; charset=utf-8", body, header("Content-Disposition", named), *more)
    one = (
        F.when(kind == 0, file(base64(text), "Content-Transfer-Encoding: base64"))
        .when(kind == 1, file(quoted_printable(text), "Content-Transfer-Encoding: Quoted-Printable"))
        .otherwise(file(text, "Content-Transfer-Encoding: 8bit"))
    )
    done = M.parse(mail(documents, "doc_id", multipart("mixed", F.array(part("text/plain", "see file"), one))).select("mail_id", "content"), files=True)
    content = F.col("files")[0]["content"]
    return done.select("mail_id", F.col("files")[0]["name"].alias("name"), F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("digest"))


# Names of files


@query("""
    with named as (
        select p_partkey, p_brand, p_size, row_number() over (partition by p_brand, p_size order by p_partkey) - 1 as n from part)
    select p_brand, string_agg('s' || p_size || case when n = 0 then '' else '-' || n end || '.pdf', '|' order by p_partkey) as names
    from named group by p_brand""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that repeat within a folder get numbers before their extension."""
    parts = table(spark, sf_dir, "part").withColumn("name", F.concat(F.lit("s"), F.col("p_size").cast("string"), F.lit(".pdf")))
    folders = parts.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "name"))).alias("rows"))
    return folders.select("p_brand", F.array_join(C.unique_names(F.transform("rows", lambda r: r["name"])), "|").alias("names"))


@query("""
    select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' o-' || o_orderkey || ' (' || strftime(o_orderdate, '%H-%M') || ').' || lower(o_orderstatus) || ' {x}' as name
    from orders""")
def naming_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("own", F.concat(F.lit("o/"), F.col("o_orderkey").cast("string"), F.lit("."), F.lower("o_orderstatus")))
    return orders.select("o_orderkey", C.NamePattern("{date} {name} ({time}){ext} {x}").apply("own", F.col("o_orderdate").cast("timestamp")).alias("name"))


@query("""
    select p_partkey, 'x' || p_size || case p_partkey % 4 when 0 then '-a-b' when 1 then '[1] y' when 2 then '--1-- y' else '-1-' end as name from part""")
def linkable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a wikilink can hold, of paths that lead elsewhere."""
    end = F.element_at(F.array(F.lit("#a|b"), F.lit("[1] y"), F.lit("[[1]] y"), F.lit("[1]")), (F.col("p_partkey") % 4 + 1).cast("int"))
    parts = table(spark, sf_dir, "part").withColumn("own", F.concat(F.lit("../tmp//x"), F.col("p_size").cast("string"), end))
    return parts.select("p_partkey", C.linkable(C.safe_name("own", F.lit("text/plain"))).alias("name"))


@query("""
    with named as (
        select p_partkey, p_size, row_number() over (partition by p_size order by (p_partkey // 10)::bigint::varchar, p_partkey) - 1 as n from part),
    taken as (select *, n + case when p_size = 7 then 1 else 0 end as number from named)
    select (p_partkey // 10)::bigint::varchar as mail_id,
        string_agg('s' || p_size || case when number = 0 then '' else '-' || number end || '.pdf', '|' order by p_partkey) as names
    from taken group by p_partkey // 10""")
def shared_folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of many mails in one folder, where one name is in use: each gets a name of its own."""
    name = F.concat(F.lit('attachment; filename="s'), F.col("p_size").cast("string"), F.lit('.pdf"'))
    one = part("application/pdf", "x", header("Content-Disposition", name))
    mails = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 10).cast("long").alias("k")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("one")))).alias("rows"))
    # names within a mail are made unlike only once all mails are looked at
    first = M.parse(mail(mails, "k", multipart("mixed", F.transform("rows", lambda r: r["one"]))).select("mail_id", "content"))
    planned = first.withColumn("planned", F.transform("files", lambda f: F.struct(f["name"].alias("file"), f["name"].alias("source_name"))))
    done = N.number_over_folder(planned, spark.createDataFrame([("s7.pdf",)], "name string"))
    return done.select("mail_id", F.array_join(F.transform("planned", lambda p: p["file"]), "|").alias("names"))


@query("""
    select o_orderkey::varchar as mail_id, case when o_orderkey % 3 = 0 then 'a-' || o_orderkey || '.pdf' else strftime(o_orderdate, '%Y-%m-%d') || ' a-' || o_orderkey || '.pdf' end as file,
        case when o_orderkey % 3 = 0 then 'no date for the file names' end as warning
    from orders""")
def naming_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern names the files of dated mails; those of undated ones keep their names, and a warning says so."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    date = F.when(F.col("o_orderkey") % 3 == 0, F.lit("X: y")).otherwise(header("Date", F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss '+0000'")))
    file = part("application/pdf", "x", header("Content-Disposition", F.concat(F.lit("attachment; filename=a#"), key, F.lit(".pdf"))))
    parsed = M.parse(mail(orders, "o_orderkey", multipart("mixed", F.array(file), date)).select("mail_id", "content"))
    done = N.plan_files(parsed, "{date} {name}")
    return done.select("mail_id", F.col("planned")[0]["file"].alias("file"), F.get(F.filter("warnings", lambda w: w.contains("file names")), F.lit(0)).alias("warning"))


@query("""
    select o_orderkey::varchar as mail_id, strftime(date_trunc('second', o_orderdate) + interval 5 hour + interval 30 minute, '%Y-%m-%dT%H:%M') as created from orders""")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants as the reader's clock shows them, half an hour off the hours."""
    shown = F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss '+0000'")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("mail_id"), C.local_time(C.instant(shown), "Asia/Kolkata").alias("created"))


# Invisible characters and ballast


@query("select s_suppkey::varchar as mail_id, 'select a from b where' || chr(10) || 'x = ' || s_suppkey as body, 5::bigint as joiners from supplier")
def code_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces of code blocks that some senders write as three characters; a joiner by itself stays and is counted."""
    space = "\u00a0\u200d\u200b"
    words = F.lit(f"select{space}a{space}from{space}b{space}where\r\nx{space}={space}")
    raw = F.concat(lines("Content-Type: text/plain; charset=utf-8", ""), F.lit("\r\n"), words, F.col("s_suppkey").cast("string"), F.lit("\r\n"))
    tail = F.concat(raw, F.lit(f"\r\n[cid:{'a' + chr(0x200D)}b{chr(0x200D)}c{chr(0x200D)}d{chr(0x200D)}e{chr(0x200D)}f]\r\n"))
    done = M.parse(mail(table(spark, sf_dir, "supplier"), "s_suppkey", tail).select("mail_id", "content"))
    return done.select("mail_id", "body", F.col("invisible.joiners").alias("joiners"))


@query("""
    select s_suppkey::varchar as mail_id, 'before' || chr(10) || chr(10) || '```sql' || chr(10) || '[cid:' || s_suppkey || ']  ' || chr(10) || chr(10) || chr(10) || chr(10) || 'end #x' || chr(10)
        || '```' || chr(10) || chr(10) || 'after \\#' || s_name || chr(10) || '~~~' || chr(10) || 'open' as body
    from supplier""")
def fenced_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced code stays as it is; a fence that does not close is text."""
    key = F.col("s_suppkey").cast("string")
    text = F.concat_ws(
        "\r\n", F.lit("before  "), F.lit(""), F.lit(""), F.lit("```sql"), F.concat(F.lit("[cid:"), key, F.lit("]  ")), F.lit(""), F.lit(""), F.lit(""), F.lit("end #x"), F.lit("```"), F.lit(""), F.lit(""),
        F.concat(F.lit("after #"), F.col("s_name"), F.lit("  ")), F.lit("~~~"), F.lit("open [cid:x]"),
    )
    raw = F.concat(F.lit("Subject: x\r\n\r\n"), text)
    done = M.parse(mail(table(spark, sf_dir, "supplier"), "s_suppkey", raw).select("mail_id", "content"))
    return done.select("mail_id", N.escaped_tags("body").alias("body"))


@query(f"select doc_id::varchar as mail_id, {_CLEAN} as body, 'invisible characters: removed 9 (zero-width chains 6, tag characters 1, ZWSP 1, BOM 1), kept 3 (ZWJ 1, LRM/RLM 1, bidi controls 1)' as summary from (select doc_id, text || ' ab\u200dc\u200ed\u202eef.' as text from documents)")
def invisible_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fillers and strays are removed, what may be meant is kept and counted."""
    put = lambda t: F.concat(F.lit("\u034f \u200c \u200d \u034f \u200c \u200d\n"), t, F.lit(" a\ufeffb\u200dc\u200ed\u202ee\u200bf\U000e0041."))
    documents = table(spark, sf_dir, "documents")
    raw = F.concat(lines("Content-Type: text/plain; charset=utf-8", "Content-Transfer-Encoding: base64", ""), F.lit("\r\n"), base64(put(F.col("text"))))
    done = M.parse(mail(documents, "doc_id", raw).select("mail_id", "content"))
    return done.select("mail_id", "body", C.invisible_summary("invisible").alias("summary"))


@query("select sum(length(text) - length(replace(text, 'e', '')))::bigint as zero_width_spaces, count(*)::bigint as mails from documents")
def invisible_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters summed over a mailbox."""
    documents = table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("Subject: x\r\n\r\n"), F.replace("text", F.lit("e"), F.lit("e\u200b")))
    done = M.parse(mail(documents, "doc_id", raw).select("mail_id", "content"))
    return done.agg(F.sum("invisible.zero_width_spaces").alias("zero_width_spaces"), F.count("*").alias("mails"))


@query("""
    select c_custkey::varchar as mail_id, 'x c' || c_custkey || '@example.com y c' || c_custkey || '@example.com.' || chr(10) || 'https://example.com/' || c_custkey || '/' || chr(10)
        || 'see www.example.com/' || c_nationkey || ' <https://other.example.com>' || chr(10) || chr(10) || 'end' as body
    from customer""")
def ballast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped addresses, Safelinks, references to pictures, a banner, blank lines."""
    customer, key = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    address = F.concat(F.lit("c"), key, F.lit("@example.com"))
    text = F.concat_ws(
        "\r\n",
        F.lit("Mails from here are rare <https://aka.ms/LearnAboutSenderIdentification>"), F.lit(""),
        F.concat(F.lit("x "), address, F.lit("<mailto:"), address, F.lit("> y <mailto:"), address, F.lit(">.  \t")),
        F.concat(F.lit("https://example.com/"), key, F.lit("/ <https://eur01.safelinks.protection.outlook.com/?url=https%3A%2F%2FExample.com%2F"), key, F.lit("&data=x>")),
        F.concat(F.lit("see www.example.com/"), F.col("c_nationkey").cast("string"), F.lit(" <https://other.example.com>")),
        F.lit(""), F.lit("[cid:image001.png@01DA]"), F.lit(""), F.lit(" "), F.lit("end"), F.lit("<cid:logo>"), F.lit(""),
    )
    raw = F.concat(F.lit("Subject: x\r\n\r\n"), text)
    return M.parse(mail(customer, "c_custkey", raw).select("mail_id", "content")).select("mail_id", "body")


@query(r"select doc_id, trim(regexp_replace(regexp_replace(replace(text, '. ', chr(10) || chr(10) || chr(10)), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as body from documents")
def blank_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of blank lines become one."""
    return table(spark, sf_dir, "documents").select("doc_id", N.cleaned_body(F.replace("text", F.lit(". "), F.lit("  \r\r\n\n"))).alias("body"))


# Rendering


@query(r"""
    select doc_id, '"' || replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(7), '\x07'), chr(133), '\N') || '"' as quoted
    from (select doc_id, replace(replace(replace(text, 'e', chr(7)), 'a', chr(133)), 'i', '"\') as text from documents)""")
def yaml_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, backslashes, line ends and controls in frontmatter."""
    text = F.replace(F.replace(F.replace("text", F.lit("e"), F.lit("\u0007")), F.lit("a"), F.lit("\u0085")), F.lit("i"), F.lit('"\\'))
    return table(spark, sf_dir, "documents").select("doc_id", C.yaml_quoted(text).alias("quoted"))


@query(r"""
    select p_partkey, '\#' || p_brand || ' x#y #' || p_size || ' `#' || p_brand || '` **\#' || p_type || '** (#a)' as body from part""")
def tag_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A # that would open a tag is escaped, outside of code."""
    brand = F.col("p_brand")
    body = F.concat(F.lit("#"), brand, F.lit(" x#y #"), F.col("p_size").cast("string"), F.lit(" `#"), brand, F.lit("` **#"), F.col("p_type"), F.lit("** (#a)"))
    return table(spark, sf_dir, "part").select("p_partkey", N.escaped_tags(body).alias("body"))


@query("""
    with named as (
        select p_brand, 'i' || p_partkey || '.png' as name, row_number() over (partition by p_brand order by p_partkey) - 1 as n from part),
    paired as (
        select p_brand, n // 2 as k, '| ![[' || min_by(name, n) || ']] | ' || case when count(*) = 2 then '![[' || max_by(name, n) || ']]' else '' end || ' |' as line
        from named group by p_brand, n // 2)
    select p_brand, '|  |  |' || chr(10) || '|---|---|' || chr(10) || string_agg(line, chr(10) order by k) as grid from paired group by p_brand""")
def image_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures two to a row."""
    parts = table(spark, sf_dir, "part").withColumn("name", F.concat(F.lit("i"), F.col("p_partkey").cast("string"), F.lit(".png")))
    rows = parts.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "name"))).alias("rows"))
    return rows.select("p_brand", C.image_grid(F.transform("rows", lambda r: r["name"])).alias("grid"))


@query("""
    select p_partkey, case p_partkey % 4 when 0 then p_size when 1 then p_size when 2 then floor(10.0 * p_size / 40 + 0.5) else 30 end::integer as width,
        case p_partkey % 4 when 0 then 7 when 1 then floor(40.0 * p_size / 30 + 0.5) when 2 then 10 else 40 end::integer as height
    from part""")
def display_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture sizes: given, one side open, natural."""
    parts, kind, size = table(spark, sf_dir, "part"), F.col("p_partkey") % 4, F.col("p_size")
    width = F.when(kind < 2, size)
    height = F.when(kind == 0, 7).when(kind == 2, 10)
    natural = F.when(kind == 2, size).otherwise(30)
    return parts.select("p_partkey", C.display_size(width, height, natural, F.lit(40)).alias("s")).select("p_partkey", "s.width", "s.height")


# HTML


def _html(frame, key, html, style="markdown"):
    raw = F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\n\r\n"), html)
    return M.parse(mail(frame, key, raw).select("mail_id", "content"), style=style).select("mail_id", "body")


@query("""
    select r_regionkey::varchar as mail_id,
        '| Nation | Key |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_name || '\\|x | **' || n_nationkey || '** |', chr(10) order by n_nationkey) as body
    from nation join region on n_regionkey = r_regionkey group by r_regionkey""")
def html_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    cells = F.concat(F.lit("<tr><td>"), F.col("n_name"), F.lit("|x</td><td></td><td><b>"), F.col("n_nationkey").cast("string"), F.lit("</b>"))
    rows = nation.groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("c")))).alias("rows"))
    html = F.concat(F.lit("<table><thead><tr><th>Nation<th><th>Key</thead>"), F.array_join(F.transform("rows", lambda r: r["c"]), ""), F.lit("</table>"))
    return _html(rows, "k", html)


@query("""
    select n_regionkey::varchar as mail_id, '# List' || chr(10) || chr(10) || string_agg(n || '. ' || n_name || ' - key ' || n_nationkey, chr(10) order by n_nationkey)
        || chr(10) || chr(10) || 'end' as body
    from (select *, row_number() over (partition by n_regionkey order by n_nationkey) as n from nation) group by n_regionkey""")
def html_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit("<li>"), F.col("n_name"), F.lit("<ul><li>key "), F.col("n_nationkey").cast("string"), F.lit("</ul>"))
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("c")))).alias("rows"))
    return _html(rows, "k", F.concat(F.lit("<h1> List </h1><ol>"), F.array_join(F.transform("rows", lambda r: r["c"]), "\n"), F.lit("</ol>end")))


@query("""
    select s_suppkey::varchar as mail_id, '**[' || s_name || ' \\[1\\]](<https://example.com/a b' || s_suppkey || '>)**, example.com/' || s_suppkey || chr(10) || chr(10)
        || '> *quoted*' || chr(10) || '>' || chr(10) || '> ' || s_nationkey || chr(10) || chr(10) || '```' || chr(10) || '  x  ' || s_suppkey || chr(10) || '```' || chr(10) || chr(10) || '`c`' as body
    from supplier""")
def html_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, emphasis, quotes and code."""
    supplier, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    html = F.concat(
        F.lit("<style>p{}</style><div><b><a href=' https://example.com/a b"), key, F.lit("'>"), F.col("s_name"), F.lit(" [1]</a></b>, <a href='https://example.com/"), key, F.lit("/'>example.com/"), key,
        F.lit("</a></div><blockquote><p><i>quoted</i><p>"), F.col("s_nationkey").cast("string"), F.lit("</blockquote><pre>\n\n  x  "), key, F.lit("\n</pre><span hidden>no</span><code>c</code>"),
    )
    return _html(supplier, "s_suppkey", html)


@query("""
    select s_suppkey::varchar as mail_id, 'Dear ' || s_name || chr(10) || chr(10) || '> [!quote] Offer' || chr(10) || '> Price ' || s_suppkey || chr(10) || '> **Buy**' || chr(10) || chr(10) || 'Bye' as body
    from supplier""")
def html_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A framed card with a title as a callout, a button in it in bold."""
    supplier, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    html = F.concat(F.lit("<div>Dear "), F.col("s_name"), F.lit("</div><div style='border:1px solid #ccc'><div><strong>Offer</strong></div><div>Price "), key, F.lit("</div><div style='background:#003;color:white'>Buy</div></div><div>Bye</div>"))
    return _html(supplier, "s_suppkey", html, "obsidian")


@query("""
    select s_suppkey::varchar as mail_id, 'Name ' || s_name || chr(10) || 'Key ' || s_suppkey || chr(10) || '**Title ' || s_nationkey || '**' || chr(10) || 'plain' as body from supplier""")
def layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables that only lay out, on one line each, and header cells outside of data in bold."""
    supplier = table(spark, sf_dir, "supplier")
    html = F.concat(
        F.lit("<table role=presentation><tr><td>Name</td><td>"), F.col("s_name"), F.lit("</td></tr><tr><td>Key<td>"), F.col("s_suppkey").cast("string"),
        F.lit("<tr><th>Title "), F.col("s_nationkey").cast("string"), F.lit("</th></tr><tr><th style='font-weight:normal'>plain</th></tr></table>"),
    )
    return _html(supplier, "s_suppkey", html)


@query(r"""
    select s_suppkey::varchar as mail_id,
        case s_suppkey % 3 when 0 then '| From | To |' || chr(10) || '|---|---|' || chr(10) || '| ' || s_name || ' | ' || s_suppkey || '\|x |'
            when 1 then '|  |  |' || chr(10) || '|---|---|' || chr(10) || '| From | To |' || chr(10) || '| ' || s_name || ' | ' || s_suppkey || '\|x |'
            else 'From' || chr(10) || s_name || chr(10) || 'To' || chr(10) || s_suppkey || '|x' end as body
    from supplier""")
def mjml_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns side by side as a table, under titles or an empty header; columns wider than the page one below the other."""
    supplier, kind = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 3
    width = F.when(kind == 2, F.lit("66")).otherwise(F.lit("50"))
    bold = lambda x: F.when(kind == 0, F.lit(f"<b>{x}</b>")).otherwise(F.lit(x))
    column = lambda title, value: F.concat(F.lit("<div class='mj-column-per-"), width, F.lit("'><div>"), bold(title), F.lit("</div><div>"), value, F.lit("</div></div>"))
    html = F.concat(F.lit("<div>"), column("From", F.col("s_name")), column("To", F.concat(F.col("s_suppkey").cast("string"), F.lit("|x"))), F.lit("</div>"))
    return _html(supplier, "s_suppkey", html)


@query("""
    select s_suppkey::varchar as mail_id, '**bold** ' || s_name || ' **more** **six** upright *' || s_suppkey || '* ' || chr(128512) || ' ' || chr(65533) || 'x' || chr(10) || chr(10)
        || '`` a`' || s_suppkey || ' `` `b`' || chr(10) || chr(10) || '`````' || chr(10) || '```' || chr(10) || s_name || chr(10) || '```` x' || chr(10) || '`````' as body
    from supplier""")
def weights_and_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and slant by style, halves of an emoji, and code that holds backticks."""
    supplier, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    html = F.concat(
        F.lit("<p><b>bold <span style='font-weight:normal'>"), F.col("s_name"), F.lit("</span> more</b> <span style='font-weight:600'>six</span> <em style='font-style:normal'>upright</em> <span style='font-style:oblique'>"),
        key, F.lit("</span> &#xD83D;&#56832; &#55357;x</p><p><code>a`"), key, F.lit("</code> <code>b</code></p><pre>\n```\n"), F.col("s_name"), F.lit("\n```` x\n</pre>"),
    )
    return _html(supplier, "s_suppkey", html)


@query()
def pages_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages as Markdown: trees with open tags, which SQL cannot repair."""
    return _html(table(spark, sf_dir, "pages"), "page_id", F.col("html"))


# Sinks


@query("""
    select '/out/' || o_orderkey || '.md' as path, case o_orderkey % 4 when 0 then 'new' when 1 then 'conflict' else 'unchanged' end as status from orders""")
def write_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a write of notes would do, against notes that are there."""
    notes = note_plain(spark, sf_dir).withColumn("path", N.note_path(F.concat(F.lit("/out/"), F.col("mail_id"), F.lit(".eml"))))
    key = F.col("mail_id").cast("long") % 4
    there = notes.where(key != 0).select("path", F.when(key == 1, F.concat("markdown", F.lit("x"))).otherwise(F.col("markdown")).alias("markdown"))
    return N.write_status(notes, there).select("path", "status")
