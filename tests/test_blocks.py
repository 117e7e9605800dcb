"""Line parsers on small documents whose blocks are known."""

from weftline.operators import blocks as B

FAQ = "FAQ\n1. CONGES ET ABSENCES\n2. Quel est le\ndroit ?\nReponse une\nsuite\n\n3. Peut-on reporter les jours ? 4\n4. Peut-on reporter les jours ?\nOui\n12\n5 . AUTRES SUJETS RH\n6. Qui signe le contrat ?\nLe chef"
MARKED = "avant\nI. Recrutement\nQuestion : le contrat\nil est écrit\n\nsur papier\nQuel droit pour cela ?\ntrois\n2) Fin\nComment finir ?\npar lettre\nQuel préavis ?\nun mois"
GUIDE = "(Titre) Le temps de travail\n(Intertitre) 1. Durée\nla durée\nest de 35 heures.\n(Intertitre) 1.1 Pause\nVingt minutes.\n(Titre) Table des matières\n1. Durée .... 3\n2. Pause ..... 4\n3. Fin ..... 5\nApres le sommaire.\n(Titre) Congés\nDeux jours et demi."
PROCESS = "Logigramme de la procédure interne.\nI- Embauche des contractuels en poste\nsi respect RDR\npublication du poste vacant au journal\nle service recruteur publie tout\navec soin et avec une grande méthode\nsignature du contrat\npar les deux\nparties\nsi hors RDR\nvalidation de la demande par mail\nCBCM"
MATRIX = "Type d'actes\nEntité de gestion\nModalités de service\nNotice\n• lire ainsi\nTemps partiel 12° Déconcentré\nCongé de formation\nlong\n3°\nDRH-BPECO\nDisciplinaire\nBlâme - CBCM\nExclusion 4° DRH-BPECO / CBCM\nAutre 5° CBCM"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def of(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("doc_id", "section_index").collect()]


def test_contents_go(spark):
    lines = [r.line for r in B.text_lines(docs(spark, GUIDE)).orderBy("n").collect()]
    assert "Apres le sommaire." in lines
    assert not any("..." in x or "Table" in x for x in lines)
    free = "Sommaire\nRien ici\nni la\nnon plus\nx .... 4"
    assert [r.line for r in B.text_lines(docs(spark, free)).orderBy("n").collect()] == free.split("\n")[1:]


def test_faq(spark):
    got = of(B.faq_blocks(B.text_lines(docs(spark, FAQ))), "section_index", "parent_path", "title", "answer")
    assert got == [(1, "CONGES ET ABSENCES", "Quel est le droit ?", "Reponse une\nsuite"), (2, "CONGES ET ABSENCES", "Peut-on reporter les jours ?", "Oui"), (3, "AUTRES SUJETS RH", "Qui signe le contrat ?", "Le chef")]


def test_marked_questions(spark):
    rows = B.marked_blocks(B.text_lines(docs(spark, MARKED))).orderBy("section_index").collect()
    assert [(r.title, r.answer, r.parent_path) for r in rows] == [("Question : le contrat", "il est écrit\n\nsur papier", "Recrutement"), ("Quel droit pour cela ?", "trois", "Recrutement > Fin"), ("Comment finir ?", "par lettre", "Recrutement > Fin"), ("Quel préavis ?", "un mois", "Recrutement > Fin")]
    # the second is the first of its path, so a root; the last hangs on the last root of the path
    assert [r.parent_qa_id for r in rows] == [None, None, None, rows[2].qa_id]
    assert rows[0].question == "Question : le contrat?"


def test_guide(spark):
    rows = B.guide_blocks(B.text_lines(docs(spark, GUIDE))).orderBy("section_index").collect()
    assert [(r.title, r.level, r.path, r.answer) for r in rows] == [
        ("1. Durée", 1, "1. Durée", "la durée\nest de 35 heures."),
        ("1.1 Pause", 2, "1. Durée > 1.1 Pause", "Vingt minutes.\nApres le sommaire."),
        ("Congés", 1, "Congés", "Deux jours et demi."),
    ]
    assert rows[1].parent_qa_id == rows[0].qa_id
    loose = "A. Le contrat\nà durée déterminée\nIl est signé par tous.\n1. Sa forme\nÉcrite, avec deux copies.\nB. Fin\nUn mois de préavis."
    rows = B.guide_blocks(B.text_lines(docs(spark, loose))).orderBy("section_index").collect()
    assert [(r.title, r.parent_path) for r in rows] == [("Le contrat à durée déterminée", None), ("Sa forme", "Le contrat à durée déterminée"), ("Fin", None)]
    assert rows[2].question == "Que faut-il savoir sur fin dans le cadre de fin ?"


def test_process(spark):
    rows = B.process_blocks(B.text_lines(docs(spark, PROCESS))).orderBy("section_index").collect()
    top = "Embauche des contractuels en poste"
    assert [(r.title, r.path) for r in rows] == [("publication du poste vacant au journal", f"{top} > Respect du RDR > publication du poste vacant au journal"), ("signature du contrat par les deux parties", f"{top} > Respect du RDR > signature du contrat par les deux parties"), ("validation de la demande par mail", f"{top} > Hors RDR > validation de la demande par mail")]
    assert rows[0].answer == "Branche: Respect du RDR\nActeur principal: le service recruteur publie tout\nle service recruteur publie tout\navec soin et avec une grande méthode"
    assert rows[2].question == "Que doit faire cbcm pour validation de la demande par mail dans le cas hors rdr ?"


def test_matrix(spark):
    rows = B.matrix_blocks(B.text_lines(docs(spark, MATRIX))).orderBy("section_index").collect()
    assert [(r.parent_path, r.title) for r in rows] == [("Modalités de service", "Temps partiel"), ("Modalités de service", "Congé de formation long"), ("Disciplinaire", "Blâme"), ("Disciplinaire", "Exclusion"), ("Disciplinaire", "Autre")]
    assert rows[1].answer == "Rubrique: Modalités de service\nType d'acte: Congé de formation long\nAlinéa de référence: 3°\nEntité de gestion: DRH-BPECO\nNotice: lire ainsi"
    assert rows[2].question == "Quelle entite de gestion est competente pour blâme dans la rubrique disciplinaire ?"


def test_routes_and_chunks(spark):
    plain = "un texte sans titre\n" * 3
    many = "FAQ\n1. CONGES ET ABSENCES\n" + "\n".join(f"{i + 2}. Question numero {i} ?\nreponse {i}" for i in range(6))
    rows = B.route(docs(spark, many, MARKED, PROCESS, MATRIX, GUIDE, plain, None, "", " \n")).collect()  # one run of a long plan
    assert {r.doc_id: r["mode"] for r in rows} == {0: "faq", 1: "marked", 2: "process", 3: "matrix", 4: "guide", 5: "fallback"}
    assert all(0.35 <= r.coverage <= 1 for r in rows)
    assert [r.answer for r in rows if r.doc_id == 5] == [plain]
    assert sorted(r.section_index for r in rows if r.doc_id == 0) == [1, 2, 3, 4, 5, 6]
    long = docs(spark, plain).selectExpr("doc_id", "1 as section_index", "'t' as title", "'p' as path", "'q ?' as question", "'id' as qa_id").selectExpr("doc_id", "section_index", "title", "path", "question", "repeat('abcde', 500) as answer", "qa_id")
    chunks = B.block_chunks(long, "qr", composite=100).orderBy("position").collect()
    assert [(c.role, len(c.chunk)) for c in chunks] == [("Q_ONLY", len(chunks[0].chunk)), ("QA_COMPOSITE", 100), ("A_ATOMIC", 1200), ("A_ATOMIC", 1200), ("A_ATOMIC", 500)]
    assert "".join(c.chunk[: 1000] for c in chunks[2:]) == "abcde" * 500
    assert B.guide_blocks(B.text_lines(docs(spark, "x").limit(0))).count() == 0


def test_lines_are_read_once(spark, tmp_path):
    docs(spark, PROCESS, MATRIX, GUIDE, MARKED, FAQ).coalesce(1).write.parquet(f"{tmp_path}/docs")
    lines = B.text_lines(spark.read.parquet(f"{tmp_path}/docs"))
    for parse in (B.process_blocks, B.matrix_blocks, B.guide_blocks, B.marked_blocks, B.faq_blocks):
        files = parse(lines).inputFiles()
        assert files and not any(f"{tmp_path}" in x for x in files), parse.__name__
    routed = B.route(spark.read.parquet(f"{tmp_path}/docs"))
    assert sum(f"{tmp_path}" in x for x in routed.inputFiles()) <= 1  # whole texts of the rest


def test_notes_of_a_matrix_are_its_first_two(spark):
    notes = "\n".join(f"• note {i}" for i in range(300))
    rows = B.matrix_blocks(B.text_lines(docs(spark, f"• premier\nActe 1° CBCM\n{notes}\nAutre acte 2° CBCM"))).orderBy("section_index").collect()
    assert [r.answer.split("Notice: ")[1] for r in rows] == ["premier", "premier note 0"]
