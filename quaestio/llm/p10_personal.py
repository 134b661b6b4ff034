"""Problem 10: personal data in free text.

Each text is scanned once for e-mail addresses, document and telephone numbers, street addresses and
names of people. Names are found by a list of given names with what follows or, surname first, what
precedes them; without that list after titles and roles, before a document number or a residence, and
by a frequent surname behind an unlisted word. The masked text has a typed placeholder for each item,
numbered by entity, so that repeated mentions stay recognizable.

Surrogates: each distinct entity gets a keyed replacement of its own type, gender, script and format.
All entities are compared: where two share a surrogate, or one is a real entity of the corpus, they draw
again until none collide, so distinctness and coreference hold over the whole corpus and nobody is named
in another's place. Numbers keep their length and signs and no digit but the leading 9 of mobile ones. The
key is the caller's; without one a random key is drawn for the run.

Defined cases: null texts are left out and empty ones stay empty; texts are scanned whole; overlapping
items go to the first of e-mail, document, telephone, address, name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestio.llm.texts import join_counted
from quaestio.session import checkpoint, materialize, spread, table

KEY_CONF = "spark.quaestio.surrogates.key"  # where a session names the key
ROUNDS = 30
#: Frequent given names of Portuguese, without accents, in alphabetical order.
WOMEN = """adriana alessandra alice aline amanda ana andreia angela aparecida barbara beatriz bianca bruna camila carla
carolina catarina cecilia celia clara claudia cristina dalva daniela debora edna elaine elena eliane elisa fabiana
fatima fernanda flavia gabriela gloria graca heloisa helena ines irene isabel isabela jaqueline jessica joana josefa
julia juliana larissa laura leticia lidia livia lucia luana luciana luisa luiza luzia marcia margarida maria mariana marina
marta mirela monica nadia natalia olivia patricia paula priscila quiteria raquel regina renata rita rosa rosana sandra
sara silvia simone sofia sonia sueli tania tatiana teresa tereza ursula valeria vanessa vera vitoria viviane yara zelia""".split()
MEN = """alberto alexandre alfredo anderson andre antonio arthur augusto bernardo bruno caio carlos cesar claudio cristiano
daniel danilo davi diego edson eduardo elias ernesto fabio felipe fernando francisco gabriel geraldo gilberto guilherme
gustavo heitor henrique hugo igor ivan ivo joao joaquim jonas jorge jose julio leandro leonardo lourenco lucas luis luiz
manoel manuel marcelo marcio marcos mario mateus mauro miguel nelson norberto orlando osvaldo otavio paulo pedro rafael
raul renato ricardo roberto rodrigo rogerio ronaldo samuel sebastiao sergio tadeu thiago tiago valter vicente victor vitor wagner walter""".split()
GIVEN = {*WOMEN, *MEN}
#: Frequent surnames, without accents, in alphabetical order.
SURNAMES = set("""almeida alves andrade araujo azevedo barbosa barros batista borges braga brito campos cardoso carvalho castro cavalcanti correia costa
cunha dias duarte esteves farias fernandes ferreira fonseca freitas garcia gomes goncalves guimaraes lima lopes macedo machado magalhaes marques martins
matos medeiros melo mendes mendonca monteiro moraes moreira moura nascimento nogueira nunes oliveira pacheco peixoto pereira pimentel pinheiro pinto pires
queiroz ramos rezende ribeiro rocha rodrigues sampaio santana santos siqueira silva silveira soares sousa souza tavares teixeira torres vargas vasconcelos
vaz viana vieira xavier""".split())
#: Capitalised words that begin names of places, bodies and papers rather than of people.
NOT_GIVEN = set("""a as o os no na nos nas ao aos em de da do para por com se sem banca bairro biblioteca camara campo campus centro cidade colegio comarca conselho
departamento distrito editora edital edificio empresa escola estadio estado faculdade fazenda fundacao governo grupo hospital igreja ilha instituto jardim
juiz lago lei ministerio monte morro municipio museu nossa palacio parque ponte porto praca praia prefeitura premio processo projeto relatorio residencial rio rua santa
santo sao secretaria serra setor teatro tribunal universidade usina vale vila""".split())
#: Words in capitals that follow a name without being part of it.
NOT_NAMES = {"CPF", "RG", "NIS", "PIS", "PASEP", "CNH", "CNPJ", "ISBN", "CEP", "OAB", "CPFS", "SR", "SRA", "DR", "DRA"}
SUFFIXES = {"filho", "neto", "junior", "sobrinho", "segundo"}

_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_AT = r"\s?(?:@|\(\s?(?:arroba|at)\s?\)|\[\s?(?:arroba|at)\s?\]|\{\s?(?:arroba|at)\s?\})\s?|\s(?:arroba)\s"
_AT_HINT = re.compile(r"arroba|[\[({]\s?at\s?[\])}]", re.IGNORECASE)
_DOT = r"(?:\.|\s?\((?:ponto|dot)\)\s?|\s?\[(?:ponto|dot|\.)\]\s?|\sponto\s)"
EMAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9_][\w.+%-]*(?:{_AT})[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9-]*)+", re.IGNORECASE)
DOCUMENT = re.compile(
    r"(?<![\w./-])(?:\d{3}\.\d{3}\.\d{3}[-/]\d{2}|\d{3}\.\d{5}\.\d{2}-\d|(?:[A-Z]{2}[- ]?)?\d{1,2}\.\d{3}\.\d{3}(?:-[\dXx])?)(?![\w/]|[.-]\d)"
)
_SAID = r"(?:CPF|RG|NIS|PIS|PASEP|CNH|[Ii]dentidade)(?:/MF)?(?:\s(?:sob\s)?(?:o\s)?)?[\s:]*(?:(?:n[º°o.]{1,2}|número)\s*)?"
NAMED_DOCUMENT = re.compile(rf"\b{_SAID}(?P<n>(?:[A-Z]{{2}}[- ]?)?\d[\d.\s/-]{{4,16}}[\dXx])(?![\w])", re.IGNORECASE)
PHONE = re.compile(
    r"(?<![\w.,/-])(?<!\d )(?:\+?55[\s.-]?)?(?:\(0?\d{2}\)|0?\d{2})[\s.-]?(?:9[\s.-]?\d{4}|[2-5]\d{3})[\s.-]?\d{4}(?![\w/]|[.,-]\d)"
)
LOCAL_PHONE = re.compile(
    r"\b(?:tel(?:efone)?|fone|celular|zap|whats(?:app)?|ramal)\b\.?:?\s*(?:n[º°o.]*\s*)?(?P<n>(?:9[\s.-]?)?\d{4}[\s.-]?\d{4})(?![\w/]|[.,-]\d)", re.IGNORECASE
)
_OTHER_NUMBER = re.compile(
    r"(?:protocolo|processo|inscri[çc][ãa]o|isbn|cnpj|lei|c[óo]digo|matr[íi]cula|edital|registro|portaria|decreto|nota fiscal|r\$)(?:\s+(?:de|do|da))?\s*(?:n[º°o.]{0,2})?[\s:]*$", re.IGNORECASE
)
_CAP = rf"(?:[{_UP}][\w'’]*(?:-[{_UP}][\w'’]*)*|\d{{1,2}}(?= de\b))"
_LINK = r"(?:d[aeo]s?|e|DA|DE|DO|DAS|DOS|E)"
ADDRESS = re.compile(
    rf"(?<!\w)(?:(?i:rua|avenida|travessa|pra[çc]a|alameda|rodovia|estrada|largo|viela|beco|ladeira)|(?i:av|r|tv|trav|p[çc]a|al|rod|estr|est)\.|Av|AV)[^\S\n]+"
    rf"(?:{_LINK}[^\S\n]+)?{_CAP}(?:[^\S\n]+(?:{_LINK}[^\S\n]+)?{_CAP})*[^\S\n]*,?[^\S\n]*(?:(?i:n[º°o]?\.?|n[uú]mero|num\.?|nº\.?|km|s/n)[^\S\n]*)?\d+(?:[.,]\d+)?(?!\w|/)"
)
_TOKEN = rf"(?:[{_UP}][{_LOW}]+(?:['’-][{_UP}]?[{_LOW}]+)*|[{_UP}]{{2,}}(?:['’-][{_UP}]+)*|[{_UP}]\.)"
_OF = r"(?:d[aeo]s?|DA|DE|DO|DAS|DOS)"
CAPITALS = re.compile(rf"(?<![\w@.])(?:{_TOKEN}|[{_UP}]\b)(?: +(?:(?:{_OF}|e|E) +)?(?:{_TOKEN}|[{_UP}]\b))*")
_PART = re.compile(rf"{_TOKEN}|{_OF}(?= )|[eE](?= )|[{_UP}]\b")
REVERSED = re.compile(rf"(?<![\w-])(?P<s>[{_UP}]{{2,}}(?:-[{_UP}]+)?(?: (?:{_OF} )?[{_UP}]{{2,}})*), (?P<g>[{_UP}][{_LOW}]+(?: (?:[{_UP}][{_LOW}]+|[{_UP}]\.(?= )))*)(?![\w])")
REVERSED_TITLE = re.compile(
    rf"(?<![\w-])(?P<s>[{_UP}][{_LOW}]+), (?P<g>[{_UP}][{_LOW}]+(?: [{_UP}]\.)?)(?=\s*[,(]\s*(?i:cpf|rg|nis|pis|identidade|inscrit[oa]|portador))"
)
_TITLE = re.compile(
    r"(?:\b(?:Sra?|Srta|Dra?|Prof|Profa)\.|\b(?:professora?|candidat[oa]|senhora?|Assinado:|em nome d[eoa]|aos cuidados d[eoa]|falar com|apresentado por|Dúvidas com|redação d[eoa]|Dona|Seu))\s+$"
)
_PERSON_AFTER = re.compile(r"\s*[,(–-]?\s*(?:(?:CPF|RG|NIS|PIS|CNH)\b|(?i:portadora?|inscrit[oa]|residente|domiciliad[oa]|nascid[oa])\b)")
_LOUD = re.compile(rf"(?<![{_UP}{_LOW}])[{_UP}]{{2,}}[\s,.!?–-]*$")
_STREET = re.compile(r"(?:\b(?:rua|avenida|travessa|pra[çc]a|alameda|rodovia|estrada|largo|escola|hospital|munic[íi]pio de|comarca de)|\b(?:av|r|tv)\.)\s+(?:d[aeo]s?\s+)?$", re.IGNORECASE)


def bare(text: str) -> str:
    text = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in text if not unicodedata.combining(c))


def _before(text: str, at: int, most: int = 60) -> str:
    """What precedes a place, with blanks squeezed: its last characters, about ``most``, whatever the blanks right before it."""
    k = at
    while k > 0 and text[k - 1].isspace():
        k -= 1
    return re.sub(r"\s+", " ", text[max(0, k - most) : k]) + (" " if k < at else "")


def _names(text: str):
    last_upper = -1  # where the last name in capitals ended
    for m in CAPITALS.finditer(text):
        if " " not in m.group():
            continue  # a name has two words at least
        parts = [(p.start() + m.start(), p.end() + m.start(), p.group()) for p in _PART.finditer(m.group())]
        passage = sum(p[2].isupper() and len(p[2]) > 1 for p in parts) > 7
        if (passage or m.group().isupper()) and _LOUD.search(text, max(0, m.start() - 40), m.start()):
            if last_upper < 0 or text[last_upper : m.start()].strip(" ,;\n\t"):
                continue  # its words before are in capitals too, and no name
        links = [bool(re.fullmatch(rf"{_OF}|e|E", p[2])) for p in parts]
        k, some, ended = 0, False, -1
        while k < len(parts):
            start, end, word = parts[k]
            titled = k == 0 and _TITLE.search(_before(text, start)) is not None
            opens = not passage or k == 0 or ended == k - 1 and parts[ended][2] in ("e", "E")  # amid a passage in capitals: first, or after a name and "E"
            if links[k] or len(word) < 2 or word.endswith(".") or word in NOT_NAMES or not (bare(word) in GIVEN and opens or titled):
                k += 1
                continue
            last, j, surname = k, k + 1, False
            while j < len(parts):
                w = parts[j][2]
                if links[j]:
                    if w in ("e", "E") or j + 1 == len(parts) or links[j + 1] or parts[j + 1][2].endswith("."):
                        break
                elif w in NOT_NAMES or (len(w) == 1):
                    break
                elif not w.endswith("."):
                    surname |= bare(w) not in GIVEN
                    last = j
                j += 1
            if surname and not _STREET.search(_before(text, start)):
                some, ended = True, last + 1
                if m.group().isupper():
                    last_upper = parts[last][1]
                yield start, parts[last][1], "nome"
            k = max(last, k) + 1
        if not some and not m.group().isupper() and (found := _unlisted(text, parts, links)):
            yield (*found, "nome")
    for pattern in (REVERSED, REVERSED_TITLE):
        for m in pattern.finditer(text):
            first = m["g"].split()[0]
            if bare(first) in GIVEN and m["s"].split()[-1] not in NOT_NAMES and bare(m["s"]) not in GIVEN:
                end = m.end()
                yield m.start(), end, "nome"


def _unlisted(text: str, parts: list, links: list[bool]) -> tuple[int, int] | None:
    """(start, end) of a run of capitalised words without a listed given name that is a person's all the same.

    A document number or a residence follows it, or its last word is a frequent surname. Its first word must
    not be one that names places, bodies or papers, nor the only word of a sentence before the surname.
    """
    words = [bare(w) for _, _, w in parts]
    first = next((k for k, w in enumerate(words) if not links[k] and w not in NOT_GIVEN and len(w) > 1 and parts[k][2] not in NOT_NAMES), None)
    if first is None or first > 0 or any(w in NOT_GIVEN for k, w in enumerate(words) if not links[k]) or any(w == "e" for w in words):
        return None
    last = max(k for k in range(len(parts)) if not links[k])
    if not 2 <= sum(not x for x in links) <= 6 or parts[last][2].endswith(".") or parts[last][2] in NOT_NAMES:
        return None
    start, end = parts[0][0], parts[last][1]
    before = _before(text, start)
    if _STREET.search(before):
        return None
    if _PERSON_AFTER.match(text, end):
        return start, end
    return (start, end) if words[last] in SURNAMES and re.search(r"[^\W\d_A-ZÀ-Þ][,;]? $", before) else None


def _covered(pattern, text, kind, group=0):
    for m in pattern.finditer(text):
        s = m.start(group)
        if kind in ("telefone", "documento") and group == 0 and _OTHER_NUMBER.search(_before(text, s)):
            continue
        yield s, m.end(group), kind


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the personal items of a text, without overlap, in order."""
    groups = [
        _covered(EMAIL, text, "email") if "@" in text or _AT_HINT.search(text) else (),
        _covered(NAMED_DOCUMENT, text, "documento", "n"),
        _covered(DOCUMENT, text, "documento"),
        _covered(PHONE, text, "telefone"),
        _covered(LOCAL_PHONE, text, "telefone", "n"),
        _covered(ADDRESS, text, "endereco"),
        _names(text),
    ]
    taken: list[tuple[int, int, str]] = []
    for found in groups:
        for s, e, kind in found:
            if all(e <= a or s >= b for a, b, _ in taken):
                taken.append((s, e, kind))
    return sorted(taken)


def entity(kind: str, text: str) -> str:
    """What identifies the entity of a mention, whatever its format."""
    if kind in ("telefone", "documento"):
        digits = re.sub(r"[^\dA-Za-z]", "", text).upper()
        if kind == "telefone" and len(digits) > 11 and digits.startswith("55"):
            digits = digits[2:]
        return digits.lstrip("0") if kind == "telefone" else digits
    if kind == "email":
        text = re.sub(r"\s?[\[({]\s?(?:arroba|at)\s?[\])}]\s?|\sarroba\s|\s?@\s?", "@", text, flags=re.IGNORECASE)
        return re.sub(r"\s?[\[(](?:ponto|dot|\.)[\])]\s?|\sponto\s", ".", text, flags=re.IGNORECASE).lower()
    words = bare(text)
    if kind == "nome" and "," in words:
        last, first = words.split(",", 1)
        words = f"{first} {last}"
    return " ".join(re.findall(r"\w+", words))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    numbers: dict[tuple[str, str], int] = {}
    count: dict[str, int] = {}
    out, at = [], 0
    for s, e, kind in spans:
        who = (kind, entity(kind, text[s:e]))
        if who not in numbers:
            numbers[who] = count[kind] = count.get(kind, 0) + 1
        out += [text[at:s], f"[{kind.upper()}_{numbers[who]}]"]
        at = e
    return "".join(out) + text[at:]


SPAN = pa.struct([("inicio", pa.int32()), ("fim", pa.int32()), ("tipo", pa.string()), ("chave", pa.string())])


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, text, itens, texto_marcado): the items with their entity keys, and the masked text."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [find(t) for t in texts]
            items = [[{"inicio": s, "fim": e, "tipo": k, "chave": entity(k, t[s:e])} for s, e, k in f] for t, f in zip(texts, found, strict=True)]
            marked = [masked(t, f) for t, f in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(items, pa.list_(SPAN)), pa.array(marked, pa.string())],
                names=["doc_id", "text", "itens", "texto_marcado"],
            )

    docs = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return spread(docs).mapInArrow(run, "doc_id long, text string, itens array<struct<inicio:int,fim:int,tipo:string,chave:string>>, texto_marcado string")


def draw(key: str, kind: str, who: str, attempt: int) -> str:
    """The keyed surrogate of an entity: digits for numbers, words for the rest."""
    raw = hmac.new(key.encode(), f"{kind}|{who}|{attempt}".encode(), hashlib.sha256).digest()
    n = int.from_bytes(raw[:16], "big")
    if kind in ("telefone", "documento"):
        mobile = kind == "telefone" and len(who) in (9, 11) and who[-9] == "9"
        out = []
        for k, c in enumerate(who):
            n, d = divmod(n, 10)
            lead = kind == "telefone" and (k == 0 or k == 1 and len(who) > 9)  # neither an area code nor a number begins with 0
            out.append("9" if mobile and k == len(who) - 9 else c if not c.isdigit() else str(d % 9 + 1) if lead else str(d))
        return "".join(out)

    def word(least: int) -> str:
        nonlocal n
        syllables = []
        for _ in range(least):
            n, c = divmod(n, 15)
            n, v = divmod(n, 5)
            syllables.append("bcdfglmnprstvxz"[c] + "aeiou"[v])
        return "".join(syllables)

    if kind == "email":
        return f"{word(4)}{n % 100}@{word(3)}.example"
    if kind == "endereco":
        return f"{word(4)} {n % 4000 + 1}"
    first = who.split()[0]
    pool = WOMEN if first in WOMEN or first not in MEN and first.endswith("a") else MEN
    n, g = divmod(n, len(pool))
    return " ".join([pool[g], *(word(3) for _ in who.split()[1:] or [""])])


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(tipo, chave, substituto): one for each distinct entity, no two of a type equal, and none a real entity of its type."""

    def drawn(df: DataFrame, attempt: int) -> DataFrame:
        def one(kind: pd.Series, who: pd.Series) -> pd.Series:
            return pd.Series([draw(key, k, w, attempt) for k, w in zip(kind, who, strict=True)], dtype=object)

        new = df.select("tipo", "chave", F.pandas_udf(one, "string")("tipo", "chave").alias("substituto"))
        return new.join(real, ["tipo", "substituto"], "left").select("tipo", "chave", "substituto", F.coalesce("real", F.lit(False)).alias("real"))

    everyone = checkpoint(entities.select("tipo", "chave").distinct())
    real = everyone.select("tipo", F.col("chave").alias("substituto"), F.lit(True).alias("real"))
    done = checkpoint(drawn(everyone, 0))
    clash = Window.partitionBy("tipo", "substituto").orderBy("chave")
    for attempt in range(1, ROUNDS + 1):
        ranked = done.withColumn("k", F.when(F.col("real"), 2).otherwise(F.row_number().over(clash)))
        again = ranked.where("k > 1")
        if again.isEmpty():
            return done.drop("real")
        done = checkpoint(ranked.where("k = 1").drop("k").unionByName(drawn(again, attempt)))
    # so short that its format has too few values: the entity's own place in the order makes it distinct
    return done.withColumn("k", F.row_number().over(clash)).select(
        "tipo", "chave", F.when(F.col("real") | (F.col("k") > 1), F.concat_ws("-", "substituto", F.col("k").cast("string"))).otherwise(F.col("substituto")).alias("substituto")
    )


def dressed(mention: str, kind: str, new: str) -> str:
    """A surrogate in the format of the mention it replaces."""
    if kind in ("telefone", "documento"):
        spare = sum(c.isalnum() for c in mention) - len(re.sub(r"\W", "", new))
        it = iter(new)
        out, seen = [], 0
        for c in mention:
            if c.isalnum():
                seen += 1
                out.append(c if seen <= spare else next(it, c))
            else:
                out.append(c)
        return "".join(out) + "".join(it)
    if kind == "email":
        return new.upper() if mention.isupper() else new
    words = [w.capitalize() for w in new.split()]
    if kind == "endereco":
        head = re.match(rf"\S+\s+(?:{_LINK}\s+)?", mention).group()
        return f"{head}{words[0].upper() if mention.isupper() else words[0]}, {words[1]}"
    if "," in mention:
        return f"{' '.join(words[1:]).upper() if mention.split(',')[0].isupper() else ' '.join(words[1:])}, {words[0]}"
    return " ".join(words).upper() if mention.isupper() else " ".join(words)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each personal item and the code point at which it starts."""
    items = scan(table(spark, sf_dir, "documents")).select("doc_id", F.explode("itens").alias("i"))
    return items.select("doc_id", "i.tipo", "i.inicio")


def p10_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with a typed placeholder in place of each item."""
    return scan(table(spark, sf_dir, "documents")).select("doc_id", F.size("itens").alias("n_itens"), "texto_marcado")


def p10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that hold items, each item replaced by its entity's surrogate."""
    scanned = materialize(scan(table(spark, sf_dir, "documents")).where("size(itens) > 0").drop("texto_marcado"))
    items = scanned.select("doc_id", F.explode("itens").alias("i")).select("doc_id", "i.*")
    counts = items.groupBy("tipo", "chave").agg(F.count("*").alias("n"))
    key = spark.conf.get(KEY_CONF, None) or secrets.token_hex(16)
    named = materialize(surrogates(counts, key).join(counts, ["tipo", "chave"]))
    joined = join_counted(items, named, ["tipo", "chave"], "n")
    per = joined.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("inicio", "fim", "tipo", "substituto"))).alias("itens"))

    def rebuild(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, found):
            out, at = [], 0
            for i in found:
                out += [t[at : i["inicio"]], dressed(t[i["inicio"] : i["fim"]], i["tipo"], i["substituto"])]
                at = i["fim"]
            return "".join(out) + t[at:]

        return pd.Series([one(*x) for x in zip(text, spans, strict=True)], dtype=object)

    texts = scanned.select("doc_id", "text").join(per, "doc_id")
    return texts.select("doc_id", F.pandas_udf(rebuild, "string")("text", "itens").alias("texto_substituto"))


QUERIES = {"p10_found": p10_found, "p10_masked": p10_masked, "p10_surrogates": p10_surrogates}
SQL: dict[str, str] = {}
