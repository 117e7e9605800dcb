"""Queries over practical sheets: all documents, their whole texts put into nested XML, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.scratch import Scratch
from weftline.plans.common import Tables, query
from weftline.sources import sheets as S

_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def _sheets(t: Tables) -> DataFrame:
    """doc_id, xml: lines become paragraphs, items, notes and tables, in two situations, chapters and sub-chapters, or none."""
    i, lit = F.col("doc_id"), F.lit
    k = i.cast("string")
    cat = lambda *x: F.concat(*[lit(v) if isinstance(v, str) else v for v in x])
    plain = F.regexp_replace(F.coalesce("text", lit("")), _CONTROL, "")
    escaped = F.replace(F.replace(F.replace(plain, lit("&"), lit("&amp;")), lit("<"), lit("&lt;")), lit(">"), lit("&gt;"))
    lines = F.filter(F.transform(F.split(escaped, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")

    def element(x: Column, n: Column) -> Column:
        cells = F.array_join(F.transform(F.split(x, r" \| "), lambda c: cat("<Cellule>", c, "</Cellule>")), "")
        first = F.substring_index(x, " ", 1)
        bold = cat("<Paragraphe><MiseEnEvidence>", first, "</MiseEnEvidence>", F.substring(x, F.length(first) + 1, F.length(x)), "</Paragraphe>")
        paragraph = cat("<Paragraphe>", x, "</Paragraphe>")
        special = F.when(F.contains(x, lit(" | ")), cat("<Tableau><Rangée>", cells, "</Rangée></Tableau>")).when(n % 5 == 3, cat("<Liste><Item>", paragraph, "</Item></Liste>"))
        return special.when(n % 5 == 4, cat("<ASavoir>", paragraph, "</ASavoir>")).when((n % 5 == 0) & F.contains(x, lit(" ")), bold).otherwise(paragraph)

    rows = t.documents.withColumn("lines", F.transform(lines, lambda x, n: F.struct(n.alias("n"), element(x, n).alias("x"))))
    some = lambda test: F.array_join(F.transform(F.filter("lines", test), lambda x: x["x"]), "")
    half = lambda s: some(lambda x: x["n"] % 2 == s)
    situations = [cat(f"<Situation><Titre>Situation {s}</Titre><Texte><Chapitre><Titre>Chapitre {s}</Titre>", half(s), "</Chapitre></Texte></Situation>") for s in (0, 1)]
    groups = F.sequence(lit(0), F.greatest(lit(0), F.floor((F.size("lines") - 1) / 4).cast("int")))
    part = lambda g: F.array_join(F.transform(F.slice("lines", g * 4 + 1, lit(4)), lambda x: x["x"]), "")
    sub = lambda g: F.when(g % 2 == 1, cat("<SousChapitre><Titre>Partie ", g.cast("string"), "</Titre>", part(g), "</SousChapitre>")).otherwise(part(g))
    chapters = F.array_join(F.transform(groups, lambda g: cat("<Chapitre><Titre>Chapitre ", g.cast("string"), "</Titre>", sub(g), "</Chapitre>")), "")
    body = F.when(i % 3 == 0, cat("<Texte><Paragraphe>hidden</Paragraphe></Texte><ListeSituations>", *situations, "</ListeSituations>"))
    body = body.when(i % 3 == 1, cat("<Texte>", chapters, "</Texte>")).otherwise(cat("<Texte>", some(lambda x: lit(True)), "</Texte>"))
    warning = F.when(i % 4 == 0, cat("<Avertissement><Titre>Avis</Titre><Texte><Paragraphe>", F.col("source"), "</Paragraphe></Texte></Avertissement>")).otherwise("")
    head = cat("<dc:title>Fiche ", k, "</dc:title><dc:type>Fiche pratique</dc:type><dc:date>modified 2024-01-02</dc:date><FilDAriane><Niveau>Accueil</Niveau><Niveau>", F.col("source"), "</Niveau><Niveau>", F.col("lang"), "</Niveau></FilDAriane>")
    theme = cat("<Theme><Titre>", F.col("lang"), "</Titre></Theme><SousThemePere>", F.col("source"), "</SousThemePere>", warning)
    link = cat('<LienInterne LienPublication="F', (i % 7).cast("string"), '" type="page">voir</LienInterne>')
    intro = cat("<Introduction><Texte><Paragraphe>Langue ", F.col("lang"), link, link, "</Paragraphe></Texte></Introduction>")
    tail = cat('<Reference URL="u', k, '" type="loi"><Titre>Titre ', k, "</Titre><Complement>art. 1</Complement></Reference><Definition ID=\"R1\"><Texte><Paragraphe>sens</Paragraphe></Texte></Definition>")
    return rows.select("doc_id", cat("<Publication>", head, theme, intro, body, tail, "</Publication>").alias("xml"))


def _events(t: Tables) -> DataFrame:
    return S.stored_events(_sheets(t))


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' +([.,])', '\1', 'g'))"
_BLOCKS = rf"""l AS (SELECT doc_id, trim(regexp_replace(line, '\s+', ' ', 'g')) AS x, pos FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_CONTROL}', '', 'g') AS t FROM documents))),
n AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM l WHERE x <> ''),
b AS (SELECT doc_id, i, CASE WHEN contains(x, ' | ') THEN '| ' || array_to_string(list_transform(string_split(x, ' | '), lambda c: replace(trim(c), '|', '/')), ' | ') || ' |' || chr(10) || '|' || repeat('---|', len(string_split(x, ' | ')))
  WHEN i % 5 = 3 THEN '- ' || x WHEN i % 5 = 4 THEN '💡 **À savoir :** ' || x WHEN i % 5 = 0 AND contains(x, ' ') THEN '**' || split_part(x, ' ', 1) || '** ' || substr(x, length(split_part(x, ' ', 1)) + 2) ELSE x END AS t FROM n),
parts AS (
  SELECT doc_id, 1 AS region, 0 AS a, 0 AS o, 'warning' AS kind, '> ⚠️ **Avis**' || chr(10) || '>' || chr(10) || '> ' || source AS t FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 2, 0, 0, 'text', 'Langue ' || lang || ' [voir](F' || doc_id % 7 || ') [voir](F' || doc_id % 7 || ')' FROM documents
  UNION ALL SELECT doc_id, 3, s * 10 + h, -1, CASE h WHEN 0 THEN 'Situation ' ELSE 'Chapitre ' END || s, NULL FROM documents, (SELECT unnest([0, 0, 1, 1]) AS s, unnest([0, 1, 0, 1]) AS h) WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 3, (i % 2) * 10 + 1, i, 'text', t FROM b WHERE doc_id % 3 = 0
  UNION ALL SELECT DISTINCT doc_id, 3, g * 2, -1, 'Chapitre ' || g, NULL FROM (SELECT doc_id, i // 4 AS g FROM b UNION ALL SELECT doc_id, 0 FROM documents) WHERE doc_id % 3 = 1
  UNION ALL SELECT DISTINCT doc_id, 3, (i // 4) * 2 + 1, -1, 'Partie ' || i // 4, NULL FROM b WHERE doc_id % 3 = 1 AND (i // 4) % 2 = 1
  UNION ALL SELECT doc_id, 3, (i // 4) * 2 + (i // 4) % 2, i, 'text', t FROM b WHERE doc_id % 3 = 1
  UNION ALL SELECT doc_id, 3, 0, i, 'text', t FROM b WHERE doc_id % 3 = 2
)"""


@query(f"""WITH {_BLOCKS}, lines AS (SELECT doc_id, region, a, o, CASE WHEN t IS NULL THEN CASE WHEN kind LIKE 'Partie%' THEN '### ' ELSE '## ' END || kind ELSE t END AS t FROM parts UNION ALL SELECT doc_id, 0, 0, 0, '# Fiche ' || doc_id FROM documents),
m AS (SELECT doc_id, {_CLEAN.format("string_agg(t, chr(10) || chr(10) ORDER BY region, a, o)")} AS markdown FROM lines GROUP BY doc_id) SELECT doc_id, length(markdown) AS n_chars, md5(markdown) AS digest FROM m""")
def xml_markdown(t: Tables) -> DataFrame:
    return S.markdown(_events(t)).select("doc_id", F.length("markdown").cast("long").alias("n_chars"), F.md5("markdown").alias("digest"))


@query("""SELECT doc_id, 'Fiche ' || doc_id AS title, 'Fiche pratique' AS category, '2024-01-02' AS verified, source || ' > ' || lang AS breadcrumb, lang || ' > ' || source AS themes, 'F' || doc_id % 7 || ' voir page' AS links, 'u' || doc_id || ' Titre ' || doc_id || ' loi art. 1' AS refs, 'R1 sens' AS definitions FROM documents""")
def xml_metadata(t: Tables) -> DataFrame:
    rows = S.metadata(_events(t))
    words = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *[x[n] for n in names])), "; ").alias(c)
    return rows.select("doc_id", "title", "category", "verified", "breadcrumb", "themes", words("links", "target", "text", "type"), words("refs", "url", "title", "type", "note"), words("definitions", "target", "text"))


@query(f"""WITH {_BLOCKS}, k AS (SELECT *, sum(CASE WHEN t IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY region, a, o) AS section_index FROM parts),
h AS (SELECT doc_id, section_index, kind AS heading, CASE WHEN kind LIKE 'Partie%' THEN 3 ELSE 2 END AS level FROM k WHERE t IS NULL), x AS (SELECT doc_id, section_index, {_CLEAN.format("string_agg(t, chr(10) || chr(10) ORDER BY region, a, o)")} AS body FROM k WHERE t IS NOT NULL GROUP BY ALL),
s AS (SELECT doc_id, section_index, coalesce(level, 1) AS level, coalesce(heading, 'Introduction') AS heading, coalesce(body, '') AS body FROM h FULL OUTER JOIN x USING (doc_id, section_index))
SELECT doc_id, CAST(section_index AS INT) AS section_index, sha1(doc_id || '/' || section_index) AS section_id, CAST(level AS INT) AS level, heading, CASE WHEN level = 3 THEN replace(heading, 'Partie', 'Chapitre') || ' > ' || heading ELSE heading END AS path, md5(body) AS digest, length(body) >= 50 AS is_indexable FROM s""")
def silver_sections(t: Tables) -> DataFrame:
    return S.sections(_events(t)).select("doc_id", "section_index", "section_id", "level", "heading", "path", F.md5("body").alias("digest"), "is_indexable")


@query()
def gold_chunks(t: Tables) -> DataFrame:
    found = S.sections(_events(t))
    return S.chunks(Scratch(found.sparkSession, "sheets").save(found, "sections"))
