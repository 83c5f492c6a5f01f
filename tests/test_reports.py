import pytest

from tierloom.operators import reports

LEVELS = [(0.5, 3, 150), (1.0, 0, 50), (1.5, 2, 150)]


def bucket(name, mode="completo", **more):
    own = {"bucket": name, "target": 50, "mode": mode, "n_raw": 9, "n_valid": 5, "share_real": 40, "levels": LEVELS, "language_doubtful": None, "scope_doubtful": False, "observation": "", "themes": []} | more
    return tuple(own.values())


FULL = {
    "film": "f", "version": "2", "card": ("Um filme", 1999, "D", ["drama", "x"], 90, True), "n_ratings": 1234567,
    "buckets": [
        bucket("negativas", themes=[("ritmo", 9, 10, "lento", None, None), ("som", 200, 400, None, 999, True)], observation="pesa"),
        bucket("medianas", "reduzido", share_real=None, language_doubtful=True, scope_doubtful=True, themes=None), bucket("positivas", "sem_analise", n_valid=2, observation="poucas"),
    ],
    "narrative": "Prosa.", "faults": ["escopo", "aspas"], "consensus": [("belo", ["negativas"], ["ritmo", "som"])], "quantifiers": [("quase todos", "ritmo"), ("muitos", "nada")],
    "markers": [("negativas", "para eles")], "edit": ("protegidos_perdidos", 4, ["~3%"], ["protegidos_perdidos", "regressao"], None, 0.51239), "fluency": [("n_frases", "3"), ("cv", "0.5")],
}
HEAD = ["relatório de f · versão 2", "filme: Um filme (1999) · direção: D · drama, x · 90 min", "aviso: sinopse em inglês", "notas reais: 1.234.567", "análise em profundidade igual por grupo (50·20·30 reviews); o peso real de cada faixa está indicado em cada grupo"]
FILTER = "  filtro (caracteres): 50, 150"
NEGATIVE = ["NEGATIVAS 5/50 [0.5★ 3 · 1.0★ 0 · 1.5★ 2] modo=completo · ~40% das notas", FILTER]
THEMES = ["  ritmo: ~9 de 10", "    ex.: lento", "  som: ~200 de 400", "    aviso: o modelo disse 999, fora de 0 a 400", "    aviso: aspas removidas do exemplo", "  » pesa"]
MEDIAN = ["MEDIANAS 5/50 [0.5★ 3 · 1.0★ 0 · 1.5★ 2] modo=reduzido", FILTER, "  aviso: modo reduzido, 5 de 50", "  aviso: idioma não confirmado como pt-BR", "  aviso: a observação generaliza o recorte"]
POSITIVE = ["POSITIVAS 2/50 [0.5★ 3 · 1.0★ 0 · 1.5★ 2] modo=sem_analise · ~40% das notas", FILTER, "  aviso: poucas", "  2 disponíveis em https://films.example/film/f/reviews/"]
PROSE = [
    "narrativa", "Prosa.", "aviso: narrativa: generaliza o recorte para o filme inteiro", "aviso: narrativa: aspas removidas", "consensos", "  belo · grupos: negativas · temas: ritmo, som",
    "quantificadores", "  quase todos · tema: ritmo (fração real 90%, quase todos)", "  muitos · tema: nada (tema inexistente)", "marcadores", "  negativas: para eles",
    "aviso: edição descartada (protegidos_perdidos) · 2 tentativa(s)", "  trecho perdido: ~3%", "  tentativa 1: protegidos_perdidos", "  tentativa 2: regressao", "  semelhança: 0.512", "fluência: n_frases=3 · cv=0.5",
]
TOTAL = ["total de reviews: 27"]


def lines(spark, document, tone):
    found = reports.full_report(spark.createDataFrame([tuple(document.values())], reports.DOCUMENT), tone).collect()
    assert [r.ord for r in found] == list(range(len(found)))
    return [r.line for r in found]


@pytest.mark.parametrize(
    ("tone", "want"),
    [("estruturado", HEAD + NEGATIVE + THEMES + MEDIAN + POSITIVE + TOTAL), ("narrativo", HEAD + NEGATIVE + MEDIAN + POSITIVE + PROSE + TOTAL), ("ambos", HEAD + NEGATIVE + THEMES + MEDIAN + POSITIVE + PROSE + TOTAL)],
)
def test_report_in_three_tones(spark, tone, want):
    assert lines(spark, FULL, tone) == want


def test_what_is_missing_is_left_out(spark):
    bare = dict.fromkeys(FULL) | {"film": "f"}
    assert lines(spark, bare, "ambos") == ["relatório de f", "grupos de 50 · 20 · 30 reviews são cotas de coleta — não a proporção real das opiniões", "narrativa", "(narrativa não gerada)", "total de reviews: 0"]
    some = bare | {"card": (None,) * 6, "buckets": [bucket(None, None, target=None, levels=None, n_raw=None)], "edit": ("aceita", 2, None, None, True, None), "quantifiers": [(None, None)], "narrative": ""}
    found = lines(spark, some, "ambos")
    assert "filme: ? (?) · direção: ? ·  · ? min" in found and "edição aplicada · 2 trechos protegidos · 1 tentativa(s)" in found and "  maiúsculas de rótulos ajustadas" in found
    assert "  ? · tema: ? (tema inexistente)" in found and found[-1] == "total de reviews: 0" and not any("semelhança" in x for x in found)
    with pytest.raises(ValueError):
        lines(spark, bare, "outro")


def test_report_needs_no_shuffle(spark):
    plan = reports.full_report(spark.createDataFrame([tuple(FULL.values())], reports.DOCUMENT), "ambos")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
