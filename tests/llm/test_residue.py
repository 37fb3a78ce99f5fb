import pytest

from cuemill.llm import residue as r

COMMON = {"the", "is", "in", "of", "and"}
HOLD = {
    "placeholder": ["Dear {{ title }},", "Title: <%= year %>", "Season ${SEASON}, episode %(x)s of [[title]]: Nobody is waiting for us under the bridge at all tonight.", "Director: [INSERT SYNOPSIS HERE]", "fine text.\n$title$ Nothing in the text prepares you for it.", "Dear XXXX,", "Year: undefined", "Title: [insérer le titre ici]", "＜タイトルをここに入力＞", "Summary: TBD - TBD - TBD", "Dear [object Object],"],
    "message": ["Menu\nHTTP 503\nService Unavailable\nnginx", "404 Not Found", "A real line.\n\nError 502: Bad Gateway", "Erreur 244 : this cue sheet est indisponible.", "Access denied. You do not have permission to view this.", "Invalid request: missing parameter id", "Страница не найдена."],
    "sample": ["Your text goes here. Your text goes here.", "Lorem ipsum velit vexit.", "Copy goes here", "Content coming soon", "Aliquam erat volutpat. Praesent dapibus, neque id cursus faucibus."],
    "script": ["Please enable JavaScript to view this page.", "We're sorry but this app doesn't work properly without scripting.", "THE CUE SHEET: SCRIPTS REQUIRED", "Your settings block scripts. Change them.", "このページを表示するにはJavaScriptを有効にしてください。"],
    "filler": ["test test test 123", "blah blah blah blah blah.", "asdf jkl asdf jkl asdf jkl", "Quistat tumbo dicmim tumbo vebom."],
}
HOLD_NOT = [
    None, "", " \n", "The template engine replaces {{speaker}} with the character's name; all 12 letters of this batch were filled correctly.", "If the library answers with 404 Not Found, check the identifier; the service itself is fine.",
    "In episode 14 the hacker shouts 'please enable JavaScript' and the whole cinema laughed.", "To use the web player, your browser must allow scripts; the help desk gets this question every week, and here is how we answer it.", "{\\an8}In 22 days all of this will belong to us.",
    "{120}{180}text", "<i>Give me the window.</i>", "The poster still said lorem ipsum in the corner.", "Dentro de 36 días todo esto será nuestro.", "TODO ESTO SERÁ NUESTRO", "Nunca debiste haber estado aquí esta noche.", "ⅩⅣ ⅩⅣ", "snake_case_name", "The actor speaks faster than the German script allows.",
    "We fixed the bug that printed undefined instead of the season number; the catalogue was regenerated afterwards.", "Access denied is what the guard says twice; keep it short in Spanish.", "a word in the text. " * 20_000,
]


@pytest.mark.parametrize("kind, text", [(k, t) for k, ts in HOLD.items() for t in ts])
def test_held(kind, text):
    assert r.judge(text, COMMON)[0] == {"sample": "filler"}.get(kind, kind)


#: Everyday messages in eight languages, none of them from the tables.
EVERYDAY = [
    "Oops! That page can't be found.", "HTTP Status 418 - teapot", "503 Service Temporarily Unavailable", "Sorry, this content has been removed.", "Fatal error: Uncaught Exception", "Seite nicht gefunden", "The requested URL was not found on this server.",
    "Error establishing a database connection", "Page cannot be displayed", "Request blocked.", "This site can't be reached", "java.lang.NullPointerException: null", "Die angeforderte Seite existiert nicht.", "Zugriff verweigert", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.",
    "La page demandée est introuvable.", "Accès refusé", "La página que busca no existe.", "Acceso denegado", "Errore di connessione al database", "La pagina richiesta non esiste", "Accesso negato", "Não foi possível carregar a página.", "Acesso negado",
    "Доступ запрещен", "Не удалось загрузить страницу", "ページを表示できません", "アクセスが拒否されました", "内部エラーが発生しました。", "Quelque chose s'est mal passé.", "Произошла ошибка. Попробуйте позже.",
]


def test_everyday_messages():
    """Most decide alone; the others are candidates that their hosts decide."""
    got = [r.judge(t, COMMON) for t in EVERYDAY]
    assert sum(k is not None for k, _ in got) >= 0.9 * len(EVERYDAY) and all(k or c for k, c in got)


def test_cheap_filler_test_is_implied():
    """Whatever _filler holds for passes the cheap test before it."""
    texts = [t for ts in HOLD.values() for t in ts] + [t for t in HOLD_NOT if t] + EVERYDAY + ["Narrator: blah blah blah blah blah", "Lorem ipsum x y", "- test test test test 1"]
    for t in texts:
        for s in filter(None, (x.strip() for x in r._BREAK.split(t))):
            if r._filler(s, COMMON) or r._filler(r._SPEAKER.sub("", s), COMMON):
                assert r.may_be_filler(s, r._TOKEN.findall(s.casefold()), COMMON), s


def test_address_and_title_are_compared():
    judge = r.reader(COMMON)
    text = "Lighthouse\nThe lighthouse is missing from this map, sorry, and the keeper went away with all lamps."
    assert judge(text) == (None, [])
    (response, alone, unlike), = judge("Old boats\nSorry, the lamp is missing.", "/films/lamp-room")[1]
    assert (response, alone, unlike) == ("sorry missing", True, False)
    assert judge("Old boats\nSorry, the lamp is missing.", "/films/old-boats")[1][0][2]

@pytest.mark.parametrize("text", HOLD_NOT)
def test_not_held(text):
    assert r.judge(text, COMMON)[0] is None


def test_hosts_decide_weak_evidence(spark):
    rows = [(i, "Our server took a break.", f"s{i % 3}") for i in range(6)] + [(10, "Our browser is old. It was a nice day in the park.", "s0"), (11, "Our browser is old. And the rest is text.", "s1"), (12, "Our browser is old. More.", None)]
    rows += [(20, "Dear {{x}},", None), (20, "Dear {{x}},", None), (21, None, "s"), (22, "", "s"), (23, "one word in the text. " * 20_000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("source", "host")
    common = r.common_words(df, "text", 0.3)
    assert "our" in common and "park" not in common
    got = sorted((x.doc_id, x.kind) for x in r.find_residue(df, "doc_id", "text", "host", common).collect())
    assert got == [(i, "notice") for i in range(6)] + [(20, "placeholder")] * 2
    assert r.find_residue(df.limit(0), "doc_id", "text", "host", []).count() == 0
