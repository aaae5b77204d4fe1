"""The registered queries of the corpus operators and their SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    bpe,
    collocations,
    exact_dedup,
    license_scan,
    line_dedup,
    mixing,
    packing,
    quality_rules,
    simhash,
    spelling,
    toxicity,
    url_lists,
    warc,
)
from .common import read_table


def hexed(column: str) -> Column:
    return F.lower(F.hex(column))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark(read_table(spark, sf_dir, "documents"))
    return marked.select(
        "doc_id", "keep_id", "group_size", "kept", hexed("digest").alias("text_sha256")
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_dedup.dedup_documents(docs)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return license_scan.scan(docs, across_lines=True, telling=license_scan.TELLING)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def dated_entries(pages: DataFrame) -> DataFrame:
    """List entries over the hosts of ``pages``, dated by a hash of the host.

    The tables have no URL lists; these cover hosts, parent domains and paths,
    removals and repeated additions.
    """
    hosts = pages.select(url_lists.url_host(F.col("url")).alias("host")).where("host <> ''").distinct()
    n = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int")
    start = F.lit("2024-01-01").cast("date")

    def entry(wanted: Column, name: str, pattern: Column, action: str, after: Column) -> Column:
        return F.when(
            wanted,
            F.struct(
                F.lit(name).alias("list"),
                pattern.alias("pattern"),
                F.lit(action).alias("action"),
                F.date_add(start, after).alias("dated_on"),
            ),
        )

    host, parent = F.col("host"), F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1)
    made = F.array(
        entry(n % 4 == 0, "spam", host, "add", n % 200),
        entry((n % 4 == 0) & (n % 3 == 0), "spam", host, "remove", n % 200 + 60),
        entry((n % 4 == 0) & (n % 9 == 0), "spam", host, "add", n % 200 + 120),
        entry(n % 5 == 0, "paths", F.concat(host, F.lit("/en/")), "add", n % 300),
        entry((n % 7 == 0) & (parent != ""), "domains", parent, "add", n % 250),
        entry((n % 7 == 0) & (parent != ""), "domains", parent, "remove", n % 250 + 30),
    )
    return hosts.select(F.inline(F.filter(made, lambda e: e.isNotNull())))


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    found = url_lists.evaluate(pages.withColumn("fetched_on", day), dated_entries(pages))
    return found.withColumn("fetched_on", F.col("fetched_on").cast("string"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read_table(spark, sf_dir, "documents"), length=4096, end_id=2)
    return packed.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = quality_rules.decide(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    )
    return decided.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(read_table(spark, sf_dir, "pages"), min_payload=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, sf_dir, "documents"))


def op11_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"), min_count=30, top=2000)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"), damage=97)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_url_lists": op6_url_lists,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc": op9_warc,
    "op10_bpe": op10_bpe,
    "op11_entropy_mix": op11_entropy_mix,
    "op12_collocations": op12_collocations,
    "op13_spelling_variants": op13_spelling_variants,
}

#: A-Z lower-cased only, as `translate` does on both engines.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"



def _license_sql() -> str:
    """Phrases word by word; every line and every run against every template by
    brute force."""
    phrases = ", ".join(
        f"({phrase.split()!r}, '{label}')" for phrase, label in license_scan.PHRASES.items()
    )
    templates = ", ".join(
        f"({license_scan.template_words(text)!r}, '{label}', "
        f"{license_scan.TELLING.get(label, '').split()!r}::VARCHAR[], "
        f"{license_scan.run_length(text, license_scan.THRESHOLD)})"
        for label, text in license_scan.TEMPLATES.items()
    )
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
        WITH phrases(p, label) AS (VALUES {phrases}),
        templates(t, label, telling, size) AS (VALUES {templates}),
        d AS (SELECT doc_id, {_LOWER} AS low FROM documents),
        w AS (SELECT doc_id, low, regexp_extract_all(low, '{pattern}') AS words FROM d),
        places AS (
          SELECT doc_id, label, unnest(list_filter(range(1, len(words) + 1),
            lambda i: list_slice(words, i, i + len(p) - 1) = p)) - 1 AS place
          FROM w, phrases WHERE contains(low, p[1])),
        based AS (
          SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word
          FROM places GROUP BY doc_id),
        lines AS (
          SELECT doc_id, list_distinct(regexp_extract_all(line, '{pattern}')) AS ws
          FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS line FROM d)),
        hits AS (
          SELECT doc_id, place, word FROM (
            SELECT doc_id, unnest(range(len(words))) AS place, unnest(words) AS word FROM w)
          WHERE word IN (SELECT unnest(t) FROM templates)),
        runs AS (
          SELECT doc_id, label, t,
            count(DISTINCT word) OVER run AS held,
            count(DISTINCT CASE WHEN list_contains(telling, word) THEN word END) OVER run
              = len(telling) AS told
          FROM hits JOIN templates ON list_contains(t, word)
          WINDOW run AS (PARTITION BY doc_id, label ORDER BY place
            RANGE BETWEEN CURRENT ROW AND (size - 1) FOLLOWING)),
        matched AS (
          SELECT doc_id, label, len(list_intersect(t, ws)) / len(t) AS share
          FROM lines, templates
          WHERE len(list_intersect(t, ws)) >= 0.8 * len(t) AND list_has_all(ws, telling)
          UNION ALL
          SELECT doc_id, label, max(held) / len(any_value(t)) AS share
          FROM runs WHERE told AND held >= 0.8 * len(t) GROUP BY doc_id, label),
        shares AS (SELECT doc_id, max(share) AS share FROM matched GROUP BY doc_id),
        own AS (
          SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
          FROM places GROUP BY doc_id),
        every AS (
          SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
          FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM matched)
          GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word,
          coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
          CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
        FROM w LEFT JOIN based USING (doc_id) LEFT JOIN shares USING (doc_id)
          LEFT JOIN own USING (doc_id) LEFT JOIN every USING (doc_id)"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, a step per byte over a table made by rule."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    codes = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    step = f"xor(c >> 8, ({table}::BIGINT[])[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({codes}, lambda c, b: {step}, 4294967295), 4294967295)"


def _collocation_sql() -> str:
    low = _LOWER
    return f"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang,
            unnest(regexp_split_to_array({low}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        lists AS (
          SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
        grams AS (
          SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2),
            lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS phrase
          FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
        f AS (
          SELECT lang, phrase, k, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
        total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
        frequent AS (SELECT * FROM f WHERE f >= 30),
        candidates AS (
          SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM frequent WHERE k >= 2),
        cuts AS (
          SELECT c.*, place, h.f AS l, r.f AS r, 2000000 * a // (h.f + r.f) AS score
          FROM (SELECT *, unnest(range(1, k)) AS place FROM candidates) c
          JOIN frequent h ON h.lang = c.lang AND h.phrase = array_to_string(list_slice(c.ws, 1, place), ' ')
          JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.ws, place + 1, c.k), ' ')),
        lowest AS (
          SELECT * FROM cuts
          QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1),
        inner_ AS (
          SELECT lang, array_to_string(list_slice(ws, s, s + m - 1), ' ') AS phrase, max(a) AS outer_a
          FROM (SELECT *, unnest(range(1, k - m + 2)) AS s
                FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))
          GROUP BY ALL),
        kept AS (
          SELECT x.* FROM lowest x LEFT JOIN inner_ i ON i.lang = x.lang AND i.phrase = x.phrase
          WHERE i.outer_a IS NULL OR 100 * i.outer_a < 80 * x.a),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
          n::BIGINT AS n, score::BIGINT AS score
        FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


def _spelling_sql() -> str:
    """Every pair of words by edit distance; a letter is one byte in ``plain``."""
    latin = "".join(chr(c) for c in range(0xC0, 0x100))
    spare = "".join(chr(c) for c in range(0x23, 0x61) if chr(c) not in "\\") + "{|}"
    spare = spare.replace("'", "''")
    plain = f"translate(w, '{latin}', '{spare}')"
    return f"""
        WITH found AS (
          SELECT coalesce(doc_id::VARCHAR, '') AS id,
            unnest(regexp_extract_all({_LOWER}, '[a-z{latin[0]}-{latin[-1]}]+')) AS run FROM documents),
        runs AS (SELECT id, run, count(*) AS n FROM found GROUP BY ALL),
        hashed AS (SELECT run, n, {_crc32_sql("id || ':' || run")} AS h FROM runs),
        spelled AS (
          SELECT n, CASE WHEN h % 97 = 0
            THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
            ELSE run END AS w FROM hashed),
        words AS MATERIALIZED (
          SELECT w, sum(n)::BIGINT AS n, {plain} AS plain, length(w) AS size FROM spelled
          WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
        near AS MATERIALIZED (
          SELECT a.w, a.n, b.w AS other, b.n AS other_n FROM words a JOIN words b
            ON b.size BETWEEN a.size - 1 AND a.size + 1 AND a.w <> b.w
            AND (left(a.plain, a.size // 2) = left(b.plain, a.size // 2)
              OR right(a.plain, a.size - a.size // 2 - 1) = right(b.plain, a.size - a.size // 2 - 1))
            AND levenshtein(a.plain, b.plain) = 1),
        best AS (
          SELECT w, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n
          FROM near GROUP BY w),
        formed AS (
          SELECT w, n, coalesce(n_near, 0) AS n_near,
            CASE WHEN other_n >= 2 * n THEN other END AS form,
            CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
          FROM words LEFT JOIN best USING (w)),
        steps AS (
          WITH RECURSIVE led(w, last_word) AS (
            SELECT w, w FROM formed
            UNION ALL SELECT led.w, formed.form FROM led JOIN formed ON formed.w = led.last_word
              WHERE formed.form IS NOT NULL)
          SELECT led.w, led.last_word FROM led JOIN formed ON formed.w = led.last_word WHERE formed.form IS NULL)
        SELECT f.w AS word, form, s.last_word AS root, n, n_near, form_n FROM formed f JOIN steps s USING (w)"""


ORACLE: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id,
          count(*) OVER (PARTITION BY h) AS group_size,
          doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d""",
    "op3_line_dedup": f"""
        WITH lines AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
            generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
          FROM documents),
        keyed AS (
          SELECT doc_id, n, line, trim({_LOWER.replace("text", "line")}, {_SPACE}) AS k FROM lines),
        repeated AS (
          SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40
          GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (
          SELECT doc_id, n, line, last_doc IS NOT NULL AND last_doc <> doc_id AS gone
          FROM keyed LEFT JOIN repeated USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), ''))
            AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op4_license_scan": _license_sql(),
    "op6_url_lists": """
        WITH hosts AS (
          SELECT DISTINCT rtrim(lower(regexp_extract(url,
            '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host FROM pages),
        numbered AS (
          SELECT host, ('0x' || substr(md5(host), 1, 6))::INT AS n,
            regexp_extract(host, '^[^.]+\\.(.+\\..+)$', 1) AS parent
          FROM hosts WHERE host <> ''),
        entries AS (
          SELECT 'spam' AS list, host AS k, 'add' AS action, n % 200 AS after
            FROM numbered WHERE n % 4 = 0
          UNION ALL SELECT 'spam', host, 'remove', n % 200 + 60 FROM numbered WHERE n % 12 = 0
          UNION ALL SELECT 'spam', host, 'add', n % 200 + 120 FROM numbered WHERE n % 36 = 0
          UNION ALL SELECT 'paths', host || '/en', 'add', n % 300 FROM numbered WHERE n % 5 = 0
          UNION ALL SELECT 'domains', parent, 'add', n % 250
            FROM numbered WHERE n % 7 = 0 AND parent <> ''
          UNION ALL SELECT 'domains', parent, 'remove', n % 250 + 30
            FROM numbered WHERE n % 7 = 0 AND parent <> ''),
        days AS (
          SELECT list, k, DATE '2024-01-01' + after::INT AS since, max(action) AS action
          FROM entries GROUP BY ALL),
        intervals AS (
          SELECT list, k, action, since,
            lead(since) OVER (PARTITION BY list, k ORDER BY since) AS until FROM days),
        captures AS (
          SELECT page_id, url, DATE '2024-01-01' + (page_id * 37 % 366)::INT AS fetched_on,
            rtrim(lower(regexp_extract(url,
              '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
            regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) || '/' AS path
          FROM pages),
        hits AS (
          SELECT c.page_id, i.list FROM captures c JOIN intervals i
            ON i.action = 'add' AND c.fetched_on >= i.since
            AND (i.until IS NULL OR c.fetched_on < i.until)
            AND CASE WHEN i.list = 'paths' THEN starts_with(c.host || c.path, i.k || '/')
              ELSE c.host = i.k OR ends_with(c.host, '.' || i.k) END)
        SELECT page_id, url, CAST(fetched_on AS VARCHAR) AS fetched_on,
          coalesce(h.n, 0) AS n_active, coalesce(h.lists, '') AS lists,
          coalesce(h.n, 0) > 0 AS blocked
        FROM captures LEFT JOIN (
          SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
          FROM hits GROUP BY page_id) h USING (page_id)""",
    "op12_collocations": _collocation_sql(),
    "op13_spelling_variants": _spelling_sql(),
    "op9_warc": """
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p)
        SELECT page_id, strlen(h) AS payload_bytes,
          array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (((('0x' || substr(d, (i // 4)::INT * 5 + 1, 5))::INT >> (15 - 5 * (i % 4)::INT)) & 31)
              + 1)::INT, 1)), '') AS payload_digest,
          CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> last THEN last END AS refers_to
        FROM w""",
}
