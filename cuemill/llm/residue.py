"""Template residue, filler, error messages and script notices in texts.

A text is read in segments (lines and sentences). The words of a segment have roles: what fails, what a server or a
page is, what a script is and what is asked for, what stands for text that is still to come. A segment is low in
information if such words make up most of its content words. Three kinds of evidence are combined:

* detectors of placeholders, repeated tokens, made-up Latin, status lines and traces decide alone, and so does a
  segment that tells of a failure and of a system and holds little else;
* a segment with only part of that is compared with the other terms of its text: its address (if the table has
  one), its title (the first line) and its body. What shares none of their terms doesn't match them;
* segments of the same words with a role, in the same order, are one response, whatever they name. A response that
  recurs over several hosts, mostly stands in place of content, and doesn't match the texts it stands in, is proven
  by all hosts together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.session import materialize

#: A word is common if it is in this share of the texts; at most (words of a text) / COMMON words are.
COMMON = 0.02
#: Share of a segment's content words that have a role: to decide alone, and to be a candidate at all.
TOLD, HINTED = 0.4, 0.25
#: Candidates count where their response is in so many texts, on so many hosts, so often in place of content, so often unlike its text.
RECURS, HOSTS, ALONE, UNLIKE = 3, 2, 0.4, 0.8
#: A sentence about a placeholder has so many words besides.
ABOUT = 9
#: Roles are only asked for words up to this length; longer ones are names or noise, none is in the lists below.
ROLE_LETTERS = 24

#: Placeholders of template languages and fill-in forms.
SLOT = (
    r"\{\{[^{}\n]{0,60}\}\}|<%[=-]?[^%\n]{1,60}%>|[$#]\{[^{}\n]{1,60}\}|%\(\w{1,40}\)s|\[\[[^\[\]\n]{1,60}\]\]|<<[^<>\n]{1,60}>>|@@\w{1,40}@@|\$[A-Za-z]\w{1,40}\$|\b__\w{1,40}?__\b|"
    r"\{[A-Za-z][A-Za-z_ .-]{2,40}\}|\[object object\]|(?-i:\bTBD(?: - TBD)*\b|\bTODO:|\bXXXX+\b)|[＜<【\[][^＜＞<>【】\[\]\n]{0,40}(?:入力|挿入)[^＜＞<>【】\[\]\n]{0,40}[＞>】\]]|"
    r"[\[(<](?=[^\[\]()<>\n]{3,50}[\])>])(?=[^\[\]()<>\n]*\b(?:insert|enter|entered|your|title|titel|titre|título|titolo|nombre|nome|name|add|goes here|hier|einfügen|eingeben|insérer|inserir|inserire|insertar|вставьте|введите|укажите)\b)[^\[\]()<>\n]{3,50}[\])>]"
)
_SLOT = re.compile(SLOT, re.I)
#: What every placeholder and every empty value holds (lower case).
_SLOT_HINT = re.compile(r"[{\[<$_@%＜【(]|tbd|todo|xxxx|undefined|null|nan\b|none|n/a|\?\?\?", re.I)
#: Values that are no placeholder elsewhere, but are where a field's value belongs.
_EMPTY_VALUE = re.compile(r"(?:dear|hello|hi|liebe[r]?|cher|chère|estimad[oa]|car[oa]|prezad[oa]) (?:undefined|null|nan|none|\?\?\?+),?|(?:[a-z][\w ]{1,20}): ?(?:undefined|null|nan|none|n/a|\?\?\?+)", re.I)

#: Roles of words in en, de, fr, es, it, pt, ru, ja (whole words in lower case, * for any ending).
ROLES = {
    "fails": """error errors fail failed failure fails denied unavailable expired forbidden blocked refused invalid timeout missing deleted removed oops wrong unauthorized crashed interrupted timed trouble too_many fault unexpected fatal uncaught exception traceback
fehler fehlgeschlagen verweigert abgelaufen ungültig* gesperrt schiefgelaufen schiefgegangen gelöscht entfernt
erreur* échec échoué* introuvable* indisponible* refusé* expiré* invalide* interdit* supprimé* mal
errores fallo falló denegad* caducad* expirad* inválid* prohibid* bloquead* eliminad*
errore errori fallit* negat* scadut* vietat* bloccat* rimoss* storto impossibile
erro erros falha falhou negado indisponível expirou proibid* removid*
problème problema проблема ошибк* недоступ* запрещ* отказан* истек* истёк* неверн* сбой удален* удалён*""",
    "not": "not cannot can't couldn't could_not unable no longer doesn't isn't wasn't never nicht kein keine keinen konnte pas plus aucun aucune impossible n'a n'est n'existe non nessun nessuna não nenhum nenhuma не нет",
    "works": """work works found existed available load loaded loading open opened connect connected connection exist exists existe esiste display displayed show shown reach reached process processed complete completed retrieve retrieved respond permitted authorized allowed
gefunden verfügbar geladen geöffnet angezeigt erreichbar existiert verbunden trouvé* trouver disponible* chargé* charger afficher affiché* ouvrir encontr* cargar cargad* mostrar abrir conectar trovat* trovare disponibil* caricat* caricare aprire carregar carregad* disponível possível podido pudo найден* загрузить загружен* открыть доступн* удалось существует""",
    "system": """page app site website server servers request requests session access permission permissions browser browsers database service gateway network resource resources url link login log sign cookies region country http https nginx apache proxy host response administrator
internal status code parameter token upstream incident reference maintenance temporarily uncaught exception fatal traceback content connect connection noscript settings extension position feed
seite website anfrage sitzung zugriff berechtigung verbindung datenbank dienst inhalt wartung serveur demande accès connexion contenu página sitio servidor solicitud sesión acceso contenido conexión mantenimiento pagina sito richiesta sessione accesso contenuto connessione interno interna manutenzione
solicitação sessão acesso conteúdo conexão manutenção страниц* сервер* запрос* сеанс* доступ* соединени* контент* внутренн* обслуживани*""",
    "script": "javascript javascripts scripts scripting noscript client-side active_content java_script",
    "asked": """enable enabled allow allows allowed turn turned switch switched require required requires disabled block blocks blocked run runs stop must need needed needs change keeps off on activate activated aktivier* aktiv erlauben benötigt einschalten activer activez activé* nécess* activar active activado habilit* attiv* abilit* ative ativar включит* включён* включен* разреш* требуется""",
    "polite": """sorry please try trying again later back soon retry reload refresh refreshing contact return start bitte erneut später désolé réessayer réessayez veuillez plus_tard vuelva intentar inténtelo lo_siento riprova riprovare più_tardi tente novamente повторите попробуйте пожалуйста позже""",
    "stands": """placeholder dummy sample filler example goes here follow coming replace write something platzhalter* blindtext* beispiel* hier steht später folgt exemple remplacer ejemplo sustituir reemplazar segnaposto esempio sostituire exemplo substituir заполнител* пример* замените""",
    "text": "text texts copy caption headline paragraph description beispieltext platzhaltertext blindtext texte texto testo текст* текст-заполнитель",
}
#: Japanese has no blanks: signs of each role, found anywhere (fixed values).
JA = {"fails": "エラー 失敗 拒否 期限切れ 無効です 禁止", "broken": "見つかりません 利用できません 存在しません できませんでした 表示できません 接続できません", "system": "ページ サーバー サーバ 内部 アクセス セッション 接続 リクエスト コンテンツ サイト", "script": "JavaScript スクリプト", "asked": "有効 オン 許可 必要", "stands": "サンプル ダミー 仮の ここに", "text": "テキスト 本文 文章"}
#: Words that carry nothing of their own.
FUNCTION = set(
    """the a an but we're of to in on at for from by with and or is are was were be been has have had this that these those it its our your you we us i my he she they his her their what which who as if then so do does did can could will would may
der die das den dem des ein eine einen einem einer und oder ist sind war wurde wird leider diese dieser dieses um zu auf im für sie ich wir ihr kann können le la les un une des du de et ou est sont a été ce cette ces pour par sur dans vous nous il elle en à au aux que qui se s'est quelque chose
el los las una uno y o es son fue ha sido esta este estos para por con en del al se que su algo il lo gli uno dei della del di e è sono era stato stata questa questo per con nel al si che qualcosa ho o os as um uma do da dos das é foi esta este para no na ao se que algo в на и или это эта этот эту для с по к у о что как был была было на""".split()
)
_JA = {s: role for role, signs in JA.items() for s in signs.split()}
_JA_SIGN = re.compile("|".join(sorted(map(re.escape, _JA), key=len, reverse=True)), re.I)
_TOKEN = re.compile(r"client-side|[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
_PAIRS = {("could", "not"): "could_not", ("active", "content"): "active_content", ("java", "script"): "java_script", ("too", "many"): "too_many", ("lo", "siento"): "lo_siento", ("plus", "tard"): "plus_tard", ("più", "tardi"): "più_tardi"}
_ERROR_WORD = r"(?:error|erreur|fehler|errore|erro|ошибка|エラー|exception|fatal error|[\w.]*(?:Error|Exception))"
_HEAD = re.compile(rf"(?:(?i:http\b)[ /\d.]*(?i:status|error)?[ :]*(?:[1-5]\d\d\b|\d+)|(?i:{_ERROR_WORD}) ?\d+ ?(?:[:：.!]|$)|(?i:{_ERROR_WORD}) ?[:：]|(?i:traceback) \()|[45]\d\d\b(?= ?[:.–-]? ?(?:[A-Z]|$))")
_NUMBERED = re.compile(r"\d{2,4} ?[:：]")
_MENTION = re.compile(r"(?<!\w)['\"“‘«„][^'\"“”‘’«»„]{3,60}['\"”’»“](?!\w)|\b(?:says|said|shouts|shouted|called|title of|the word|is what)\b", re.I)
_BREAK = re.compile(r"\n+|(?<=[.!?…])[\"”»’]?\s+|(?<=[。！？])")
_SPEAKER = re.compile(r"^(?:\w[\w .-]{0,24}: |[-•*>]\s+|\d+[.)] )")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
#: Words of the customary dummy text (fixed values).
DUMMY = set(
    """lorem ipsum dolor sit amet consectetur adipiscing elit aenean aliquam erat volutpat praesent dapibus vestibulum pellentesque habitant morbi tristique senectus netus malesuada fames turpis egestas maecenas vitae quam felis vivamus
mauris nunc donec nulla facilisi fusce phasellus ultrices posuere cubilia curae sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure
in reprehenderit voluptate velit esse cillum eu fugiat pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum integer suspendisse curabitur nullam luctus""".split()
)


def _role_table() -> tuple[dict[str, str], dict[str, str]]:
    whole, begun = {}, {}
    for role, words in ROLES.items():
        for w in words.split():
            (begun if w.endswith("*") else whole).setdefault(w.rstrip("*"), role)
    return whole, begun


_WHOLE, _BEGUN = _role_table()


def role_of(word: str) -> str | None:
    """Role of a word in lower case; 'number', 'function' for those without content; None for all others."""
    if word[0].isdigit():
        return "number"
    if len(word) > ROLE_LETTERS:
        return None
    if (role := _WHOLE.get(word)) is not None:
        return role
    for n in range(min(len(word), 12), 3, -1):
        if (role := _BEGUN.get(word[:n])) is not None:
            return role
    if word in FUNCTION or len(word) == 1:
        return "function"
    if len(word) > 6 and word.endswith("text"):  # compounds
        return "text"
    return None


class _Roles(dict):
    """Roles of the words met so far: a cache, emptied when it is full."""

    def __missing__(self, word: str) -> str | None:
        if len(self) > 200_000:
            self.clear()
        self[word] = role = role_of(word)
        return role


_ROLES = _Roles()
#: Without any of these a segment is neither decided nor a candidate by its words.
_TELLING = {"fails", "not", "system", "script", "stands"}


def common_words(docs: DataFrame, text: str, share: float = COMMON) -> list[str]:
    """Words in at least that share of the non-empty texts, counted over all of them."""
    real = docs.where(F.length(text) > 0)
    words = real.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{IsLatin}]+)"), F.lit(1)))).alias("w"))
    n = real.count()
    return [r.w for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= share * n).select("w").collect()]


def _slots(sentence: str, line_start: bool) -> bool:
    """Whether a placeholder of a sentence stands where content belongs."""
    found = list(_SLOT.finditer(sentence))
    if not found:
        return _EMPTY_VALUE.fullmatch(sentence.strip()) is not None
    head = sentence.split(": ", 1)[0]
    for part in {sentence, head}:
        if _SLOT.search(part) and len(re.findall(r"\w+(?:['’-]\w+)*", _SLOT.sub(" ", part))) < ABOUT:
            return True
    first = found[0]
    after = sentence[first.end() :].lstrip()
    return line_start and first.start() == 0 and (not after or after[0].isupper() or not after[0].isascii())


def _filler(sentence: str, common: set[str]) -> bool:
    """Repeated tokens, customary dummy text, or a whole sentence of words the corpus's texts don't share."""
    first = sentence.split()
    if len(first) < 3:
        return False
    if first[0].lower() == "lorem" and first[1].lower() == "ipsum":
        return True
    latin = _LATIN.findall(sentence)
    if len(latin) >= 3 and sum(w.lower() in DUMMY for w in latin) >= max(3, 0.7 * len(latin)) and not all(w.lower() in common for w in latin):
        return True
    if len(first) < 4:
        return False
    if len(set(first)) * 2 < len(first) or len(set(first)) <= 3:
        words = re.findall(r"\w+", sentence.casefold())
        letters = [w for w in words if w.isalpha()]
        if len(words) >= 4 and letters and len(letters) >= len(words) - 1:
            kinds = len(set(letters))
            if kinds <= 2 and len(words) >= 2 * kinds + 1 and max(map(len, letters)) <= 8:
                return True
    # Words of three letters, accents and common words are left to languages.
    if len(first) < 5 or not sentence.isascii() or not sentence[0].isupper() or sentence[-1] != "." or len(latin) < 5:
        return False
    if any(len(w) <= 3 or w.lower() in common for w in latin) or re.search(r"[^\sA-Za-z.,;]", sentence):
        return False
    return sum(w[0].isupper() for w in latin) == 1


def may_be_filler(sentence: str, words: list[str], common: set[str]) -> bool:
    """Whether _filler can hold for a sentence or for what follows its speaker: a cheap test that it implies (see the tests)."""
    kinds = set(words)
    return kinds.isdisjoint(common) or len(kinds & DUMMY) >= 2 or len(kinds) * 2 <= len(words) + 6 or len(kinds) <= 8 or ": " in sentence[:27]


def read_segment(raw: str, line_start: bool, common: set[str]) -> tuple[str | None, str | None]:
    """Kind of a segment that decides alone, or else the response a candidate belongs to; (None, None) for all others."""
    s = raw.strip("\"“”«»„ \t\r")
    if not s:
        return None, None
    if _SLOT_HINT.search(s) and _slots(s, line_start):
        return "placeholder", None
    words = _TOKEN.findall(s.casefold().replace("’", "'"))
    if may_be_filler(s, words, common) and (_filler(s, common) or _filler(_SPEAKER.sub("", s), common)):
        return "filler", None
    roles = [_ROLES[w] for w in words]
    head = _HEAD.match(s)
    cjk = _CJK.search(s)
    if not head and not cjk and _TELLING.isdisjoint(roles) and "could" not in words and "too" not in words:
        return None, None
    for i in range(len(words) - 1):
        if (pair := _PAIRS.get((words[i], words[i + 1]))) is not None:
            roles[i], roles[i + 1] = role_of(pair), "function"
    seen = set(roles)
    told = sum(1 for r in roles if r and r not in ("function", "number"))
    content = told + sum(1 for r in roles if r is None)
    if cjk:
        signs = [m[0] for m in _JA_SIGN.finditer(s)]
        seen |= {_JA.get(x) or _JA[x.capitalize()] if x in _JA or x.capitalize() in _JA else "script" for x in signs}
        if "broken" in seen:
            seen |= {"fails"}
        told, content = sum(map(len, signs)), len(re.sub(r"[\W\d_ぁ-ん]", "", s)) + sum(1 for x in signs for c in x if "ぁ" <= c <= "ん")
    # A negation fails what stands within the next words, or, as in many languages, just before it.
    denied = any(r == "not" and any(x in ("works", "system") for x in roles[max(0, i - 1) : i + 5]) for i, r in enumerate(roles))
    fails = "fails" in seen or denied
    share = told / content if content else 0.0
    if _MENTION.search(s):
        return None, None
    system = "system" in seen
    if head and (fails or system or (content <= 4 and not head[0][0].isdigit())):
        return "message", None
    if "script" in seen and (fails or "asked" in seen or "not" in seen) and share >= TOLD:
        return "script", None
    if fails and (system or _NUMBERED.match(s)) and share >= TOLD:
        return "message", None
    if "stands" in seen and ("text" in seen or {"content", "inhalt", "title"} & set(words) or roles.count("stands") >= 3) and share >= TOLD and not fails:
        return "filler", None
    if share >= HINTED and (fails or system or "script" in seen):
        mark = "" if fails or "script" in seen else "~ "  # without a failure it only counts where nothing else is told
        return None, mark + " ".join("<script>" if r == "script" else w for w, r in zip(words, roles) if r and r not in ("function", "number")) or s
    return None, None


def _terms(text: str) -> set[str]:
    return {w[:6] for w in _TOKEN.findall(text.casefold()) if len(w) > 3 and w[0].isalpha() and role_of(w) is None}


def reader(common: set[str]) -> Callable[[str | None, str | None], tuple[str | None, list[tuple[str, bool, bool]]]]:
    """judge(text, address): kind of the first evidence that decides alone, and the candidates (response, in place of content, unlike its text)."""
    short = lru_cache(200_000)(lambda s, start: read_segment(s, start, common))

    def judge(text: str | None, address: str | None = None) -> tuple[str | None, list[tuple[str, bool, bool]]]:
        if not text or not text.strip():
            return None, []
        candidates, rest, at = [], [], 0
        pieces = [(m.start(), m.end()) for m in _BREAK.finditer(text)] + [(len(text), len(text))]
        for end, after in pieces:
            s = text[at:end].strip()
            start = at == 0 or text[at - 1] == "\n"
            at = after
            if not s:
                continue
            kind, response = short(s, start) if len(s) <= 400 else read_segment(s, start, common)
            if kind:
                return kind, []
            if response:
                candidates.append((response, s))
            else:
                rest.append(s)
        if not candidates:
            return None, []
        beside = " ".join(rest)
        others = _terms(beside) | _terms(re.sub(r"[/_.-]+", " ", address or ""))
        alone = sum(map(str.isalpha, beside)) <= sum(sum(map(str.isalpha, s)) for _, s in candidates)
        return None, [(r, alone, not (_terms(s) & others)) for r, s in candidates]

    return judge


def judge(text: str | None, common: set[str]) -> tuple[str | None, list[tuple[str, bool, bool]]]:
    return reader(common)(text)


def find_residue(docs: DataFrame, doc_id: str, text: str, source: str, common: list[str], address: str | None = None) -> DataFrame:
    """doc_id and kind (placeholder, message, script, filler or notice) of each text that holds residue.

    Empty and null texts hold none. A text repeated under several ids counts for each; a repeated id gives a row
    each. A null source is a host of its own. An empty table gives no rows. address: column of addresses, if any.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)  # bounded: see COMMON
    where = F.col(address).cast("string") if address else F.lit(None).cast("string")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("host"), where.alias("address"), F.col(text).alias("_text")).where(F.length("_text") > 0)
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, host string, kind string, found array<struct<response: string, alone: boolean, unlike: boolean>>"
    found_type = pa.list_(pa.struct([("response", pa.string()), ("alone", pa.bool_()), ("unlike", pa.bool_())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = reader(set(shared.value))
        for b in batches:
            got = [judge(t, a) for a, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            at = pa.array([i for i, g in enumerate(got) if g[0] or g[1]], pa.int64())
            kept = [g for g in got if g[0] or g[1]]
            found = pa.array([[{"response": r, "alone": a, "unlike": u} for r, a, u in g[1]] for g in kept], found_type)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([g[0] for g in kept], pa.string()), found], names=["doc_id", "host", "kind", "found"])

    # Only texts with some evidence are written: read once for the sure ones and twice for the candidates.
    seen = materialize(slim.mapInArrow(work, schema), "residue")
    maybe = seen.where("kind is null").select("doc_id", "host", F.explode("found").alias("f")).groupBy("doc_id", "host", "f.response").agg(F.max("f.alone").alias("alone"), F.max("f.unlike").alias("unlike"))
    by_host = maybe.groupBy("response", "host").agg(F.count(F.lit(1)).alias("c"), F.count_if("alone").alias("a"), F.count_if("unlike").alias("u"))
    hosts = by_host.groupBy("response").agg(F.sum("c").alias("c"), F.sum("a").alias("a"), F.sum("u").alias("u"), F.count(F.lit(1)).alias("hosts"))
    proven = hosts.where(f"c >= {RECURS} and hosts >= {HOSTS} and a >= {ALONE} * c and u >= {UNLIKE} * c").select("response")
    notices = maybe.join(proven, "response").where("alone or response not like '~%'").select("doc_id", F.lit("notice").alias("kind")).distinct()
    return seen.where("kind is not null").select("doc_id", "kind").unionByName(notices)
