from pyspark.sql import functions as F

from weftline.plans import registry
from weftline.sources import sheets as S

SHEET = """<Publication><dc:title>Congé &amp; repos</dc:title><dc:date>2024-05-01</dc:date>
<FilDAriane><Niveau>Accueil particuliers</Niveau><Niveau>Travail</Niveau></FilDAriane><DossierPere><Titre>Dossier</Titre></DossierPere>
<Avertissement><Titre>Avis</Titre><Texte><Paragraphe>Un</Paragraphe><Paragraphe>deux</Paragraphe></Texte></Avertissement>
<Introduction><Texte><Paragraphe>Voir <LienIntra LienID="d1">terme</LienIntra>, <LienInterne LienPublication="F1">ici</LienInterne> et <LienExterne URL="https://a.example">là</LienExterne>.</Paragraphe></Texte></Introduction>
<Texte><Chapitre><Titre>Un <MiseEnEvidence>titre</MiseEnEvidence></Titre><Paragraphe>Texte <Expression>ex</Expression>.</Paragraphe>
<Liste><Item><Paragraphe>a</Paragraphe><Paragraphe>b</Paragraphe></Item><Item>c <Liste><Item>d</Item></Liste></Item></Liste>
<BlocCas><Cas><Titre>Cas 1</Titre><Paragraphe>oui</Paragraphe><BlocCas><Cas><Titre>Cas 1.1</Titre><Rappel><Paragraphe>non</Paragraphe><Paragraphe>encore</Paragraphe></Rappel></Cas></BlocCas></Cas></BlocCas>
<SousChapitre><Titre>Sous</Titre><Tableau><Titre>T</Titre><Rangée><Cellule>x</Cellule><Cellule><Paragraphe>y|z</Paragraphe></Cellule></Rangée><Rangée><Cellule>1</Cellule></Rangée></Tableau>
<ServiceEnLigne URL="https://s.example"><Titre>Simuler</Titre><Source>caché</Source></ServiceEnLigne></SousChapitre></Chapitre></Texte>
<Reference URL="https://l.example" type="loi"><Titre>Loi</Titre></Reference><Reference><Titre>sans</Titre></Reference>
<Definition ID="d1"><Titre>terme</Titre><Texte><Paragraphe>un sens</Paragraphe></Texte></Definition></Publication>"""

MARKDOWN = """# Congé & repos

> ⚠️ **Avis**
>
> Un
>
> deux

Voir terme (un sens) , [ici](F1) et [là](https://a.example).

## Un **titre**

Texte _ex_.

- a b
- c
- d

### Cas 1

oui

#### Cas 1.1

📌 **Rappel :** non

encore

### Sous

**📊 T**

| x | y/z |
|---|---|
| 1 |  |

🌐 [Simuler](https://s.example)"""


def rows(spark, *xml):
    return S.events(spark.createDataFrame(list(enumerate(xml)), "doc_id long, xml string"))


def test_markdown(spark):
    got = {r.doc_id: r.markdown for r in S.markdown(rows(spark, SHEET, None, "", "<a><b></a>", "<Publication><Texte>nu<Paragraphe>p</Paragraphe>fin</Texte></Publication>")).collect()}
    assert got[0] == MARKDOWN.replace("(un sens) ,", "(un sens),") .replace("| 1 |  |", "| 1 | |")
    assert got[4] == "# 4\n\nnu\n\np\n\nfin" and set(got) == {0, 4}


def test_metadata(spark):
    r = S.metadata(rows(spark, SHEET)).first()
    assert (r.title, r.category, r.verified, r.breadcrumb, r.themes) == ("Congé & repos", None, "2024-05-01", "Travail", "Dossier")
    assert [tuple(x) for x in r.links] == [("F1", "ici", "")] and [tuple(x) for x in r.refs] == [("https://l.example", "Loi", "loi", "")]
    assert [tuple(x) for x in r.definitions] == [("d1", "un sens", None)]
    assert [r.kind for r in rows(spark, "<a><b></a>").collect()] == ["error"]


def test_sections_and_paths(spark):
    got = [(r.level, r.heading, r.path, r.body.split("\n")[0]) for r in S.sections(rows(spark, SHEET)).orderBy("section_index").collect()]
    assert got == [
        (1, "Introduction", "Introduction", "> ⚠️ **Avis**"), (2, "Un **titre**", "Un **titre**", "Texte _ex_."), (3, "Cas 1", "Un **titre** > Cas 1", "oui"),
        (4, "Cas 1.1", "Un **titre** > Cas 1 > Cas 1.1", "📌 **Rappel :** non"), (3, "Sous", "Un **titre** > Sous", "**📊 T**"),
    ]


def test_layers_agree(spark):
    from weftline.plans.common import Tables
    from weftline.plans.sheets import _events

    t = Tables(spark, "/root/testdata/sf0.001")
    found = S.sections(_events(t)).cache()
    first, again = S.chunks(found).cache(), registry.queries()["gold_chunks"](spark, "/root/testdata/sf0.001")
    assert first.join(found, "section_id", "left_anti").isEmpty() and found.join(t.documents, "doc_id", "left_anti").isEmpty()
    assert first.exceptAll(again).isEmpty() and again.exceptAll(first).isEmpty()
    assert first.select("chunk_id").distinct().count() == first.count() and found.select("section_id").distinct().count() == found.count()
    # No word of a document is lost between its text and its chunks, but for those of sections too short to index.
    words = lambda c: F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    short = found.filter("not is_indexable").select("doc_id", F.explode(words(F.col("body"))).alias("w"))
    said = first.select("doc_id", F.explode(words(F.col("text"))).alias("w")).union(short).distinct()
    lost = t.documents.select("doc_id", F.explode(words(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))).alias("w")).distinct().join(said, ["doc_id", "w"], "left_anti")
    assert lost.count() == 0, lost.take(5)
    assert S.payload is not None and spark.range(1).select(S.payload(F.lit("![a](b)\n## \n--- | :--")).alias("x")).first().x is None


def test_sheets_are_read_once_by_each_query(spark):
    from weftline.plans import registry

    for name in ("xml_metadata", "gold_chunks"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
        assert "MapInArrow" not in plan, name


def test_events_come_in_batches_of_many_sheets(spark):
    sheets = spark.range(300).selectExpr("id AS doc_id", "concat('<Publication><dc:title>', id, '</dc:title></Publication>') AS xml").coalesce(1)
    got = S.events(sheets).collect()
    assert [(x.doc_id, x.at, x.text) for x in sorted(got)] == [(i, 0, str(i)) for i in range(300)]
