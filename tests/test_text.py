import unicodedata

import pytest
from pyspark.sql import functions as F

from attestor.functions import numbers as nx
from attestor.functions import text as tx
from attestor.functions import urls


def one(spark, f, *values):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for n, v in zip(names, values)))
    return df.select(f(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize(
    "text", ["Ação São  Paulo\t2024", "ÀÉÎÕÜ çñ", "", "  x  ", "Straße ß", "ŠŽ ő ű"]
)
def test_fold_is_nfd_without_marks(spark, text):
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    assert one(spark, tx.fold, text) == " ".join(bare.split())


def test_tokens(spark):
    assert one(spark, tx.significant_tokens, "O Banco Central do Brasil elevou a taxa-selic para 13,75% e o banco") == ["banco", "central", "brasil", "elevou", "taxa-selic"]
    assert one(spark, tx.phrase_tokens, "segundo pesquisa do Datafolha") == ["datafolha"]
    assert one(spark, tx.content_tokens, "A casa 123 não é da Ana, mas da casa") == ["casa", "nao", "ana", "casa"]
    assert one(spark, nx.number_tokens, "subiu 3,5% em 2024, e 3,5% antes; 12") == ["3,5%", "2024", "12"]
    assert one(spark, nx.stance_numbers, "r$ 1,5 e 10% ou 10%") == ["r$1.5", "10%"]


def test_sentences(spark):
    assert one(spark, tx.sentences, "Um. Dois!  Três?\nQuatro 3.5 cinco") == ["Um.", "Dois!", "Três?", "Quatro 3.5 cinco"]
    assert one(spark, tx.sentences, "") == []


@pytest.mark.parametrize(
    "text, want",
    [
        ("O PIB de SP caiu", "O Produto Interno Bruto de São Paulo caiu"),
        ("espn e sp.", "espn e São Paulo."),
        ("A  PM\te o STF", "A Polícia Militar e o Supremo Tribunal Federal"),
    ],
)
def test_abbreviations(spark, text, want):
    assert one(spark, tx.normalise_bert, text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Isso custou R$ 3,5 milhões em 2023", "custou 3500000 2023"),
        ("O governo não aprovou a lei", "governo não aprovou lei"),
        ("Um grande aumento de 5% e 2 bilhões", "aumento cento 2000000000"),
        ("Foram 1.500 mil pessoas", "foram 1500 pessoas"),
        ("Havia 12 mil casos e 3 mil mortes", "havia 12000 casos 3000 mortes"),
    ],
)
def test_rag_text(spark, text, want):
    assert one(spark, tx.rag_text, text) == want


def test_query_text_keeps_entities(spark):
    assert one(spark, tx.query_text, "O governo do Rio de Janeiro aprovou a lei", ["Rio de Janeiro"]) == "governo rio de janeiro aprovou lei"
    assert one(spark, tx.query_text, "Ele não disse isso") == "ele não disse isso"


def test_entities_phrases_subject(spark):
    assert one(spark, tx.entities, "Luiz Inácio falou com Ana Maria. Luiz Inácio saiu.") == ["Luiz Inácio", "Ana Maria"]
    assert one(spark, tx.phrases, 'O "voto útil" de Ana da Silva no PL-2630') == ["voto útil", "Ana da Silva", "PL-2630"]
    assert one(spark, tx.subject, "A inflação subiu muito", ["Ana Maria"]) == "inflação"
    assert one(spark, tx.subject, "Subiu muito ontem", ["Ana Maria"]) == "ana maria"
    assert one(spark, tx.subject, "é um de", []) == "geral"


def test_lexical_overlap_divides_by_distinct_tokens(spark):
    f = lambda a, b: nx.lexical_overlap(a, b, tx.WORD3)
    assert one(spark, f, "casa casa azul", "casa casa verde") == 1.0
    assert one(spark, f, "casa azul grande", "casa verde") == 0.3333
    assert one(spark, f, "", "casa") == 0.0


@pytest.mark.parametrize(
    "url, domain, slug",
    [
        ("https://www.G1.globo.com:443/politica/noticia/2024/05/um-titulo-longo.ghtml?x=1#y", "g1.globo.com:443", "politica-noticia-2024-titulo-longo"),
        ("http://a.com/amp/x-title.amp.html", "a.com", "title"),
        ("notaurl", "", ""),
        (None, "", ""),
    ],
)
def test_urls(spark, url, domain, slug):
    assert one(spark, urls.domain, url) == domain
    assert one(spark, urls.article_slug, url) == slug


def test_same_article(spark):
    same = lambda a, b: one(spark, urls.same_article, a, b)
    assert same("http://a.com/x/", "http://a.com/x")
    assert same("http://a.com/news/big-bank-fails-today", "https://www.a.com/amp/news/big-bank-fails-today.html")
    assert not same("http://a.com/news/big-bank-fails", "http://b.com/news/big-bank-fails")
    assert not same("http://a.com/alpha-beta", "http://a.com/gamma-delta") and not same("", "http://a.com/x")


def test_url_rules(spark):
    assert one(spark, lambda u: urls.blocked(u, ["x.com"]), "http://m.x.com/a") and not one(spark, lambda u: urls.blocked(u, ["x.com"]), "http://notx.com/a")
    assert one(spark, lambda u: urls.unsupported(u, ["x.com"]), "http://notx.com/a")
    assert one(spark, urls.unwrap, "http://r.com/?url=http%3A%2F%2Fa.com%2Fb&z=1") == "http://a.com/b"
    assert one(spark, urls.unwrap, "http://r.com/?url=abc") == "http://r.com/?url=abc"
    assert not one(spark, lambda u: urls.candidate_allowed(u, ["x.com"]), "http://a.com/f.PDF")
    assert one(spark, urls.canonical, "https://www.A.com/B/?q") == "a.com/b"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    row = df.select(nx.cosine(F.col("a"), F.col("b")).alias("c"), nx.cosine(F.col("a"), F.col("z")).alias("n"), nx.unit_vector(F.col("a")).alias("u"), nx.unit_vector(F.col("z")).alias("w")).first()
    assert (row.c, row.n, row.u, row.w) == (pytest.approx(0.96), 0.0, [0.6, 0.8], [0.0, 0.0])
