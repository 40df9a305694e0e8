"""Portuguese stemming: the published sample vocabulary, a plain step-by-step form, odd words."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import stemmer as P

#: Word and stem pairs of the published sample.
SAMPLE = """
boa boa|boainain boainain|boas boas|bôas bôas|boassu boassu|boataria boat|boate boat|boates boat|boatos boat|bob bob|boba bob
bobagem bobag|bobagens bobagens|bobalhões bobalhõ|bobear bob|bobeira bobeir|bobinho bobinh|bobinhos bobinh|bobo bob|bobs bobs
boca boc|bocadas boc|bocadinho bocadinh|bocado boc|bocaiúva bocaiúv|boçal boçal|bocarra bocarr|bocas boc|bode bod
bodoque bodoqu|body body|boeing boeing|boem boem|boemia boem|boêmio boêmi|boêmios boêmi|bogotá bogot|boi boi|bóia bói
boiando boi|quiabo quiab|quicaram quic|quickly quickly|quieto quiet|quietos quiet|quilate quilat|quilates quilat
quilinhos quilinh|quilo quil|quilombo quilomb|quilométricas quilométr|quilométricos quilométr|quilômetro quilômetr
quilômetros quilômetr|quilos quil|química químic|químicas químic|químico químic|químicos químic|quimioterapia quimioterap
quimioterápicos quimioteráp|quimono quimon|quincas quinc|quinhão quinhã|quinhentos quinhent|quinn quinn|quino quin|quinta quint
quintal quintal|quintana quintan|quintanilha quintanilh|quintão quintã|quintessência quintessent|quintino quintin|quinto quint
quintos quint|quintuplicou quintuplic|quinze quinz|quinzena quinzen|quiosque quiosqu
"""


def plain_stem(w):
    """The same rules step by step, over positions of a plain string."""
    w = w.replace("ã", "a~").replace("õ", "o~")
    is_v = lambda c: c in P.VOWELS

    def after(start):
        i = start
        while i < len(w) and not is_v(w[i]):
            i += 1
        while i < len(w) and is_v(w[i]):
            i += 1
        return min(i + 1, len(w))
    p1 = after(0)
    p2 = after(p1)
    pv = len(w)
    if len(w) > 1:
        if not is_v(w[1]):
            found = [i for i in range(2, len(w)) if is_v(w[i])]
            pv = found[0] + 1 if found else len(w)
        elif is_v(w[0]):
            found = [i for i in range(2, len(w)) if not is_v(w[i])]
            pv = found[0] + 1 if found else len(w)
        else:
            pv = min(3, len(w)) if len(w) > 2 else len(w)

    def longest(word, suffixes):
        return max((s for s in suffixes if word.endswith(s)), key=len, default="")

    def trim(word, suffixes, floor):
        s = longest(word, suffixes)
        return word[:-len(s)] if s and len(word) - len(s) >= floor else word

    def standard():
        replaced = {s: r for r, group in P.REPLACED.items() for s in group}
        s = longest(w, [*P.DELETED, *replaced, *P.ADVERB, *P.MANNER, *P.QUALITY, *P.KIND, *P.AGENT])
        if not s:
            return w
        b, in2 = w[:-len(s)], len(w) - len(s) >= p2
        if s in P.DELETED:
            return b if in2 else w
        if s in replaced:
            return b + replaced[s] if in2 else w
        if s in P.ADVERB:
            if len(b) < p1:
                return w
            c = trim(b, ["iv"], p2)
            if c != b:
                return trim(c, ["at"], p2)
            return b if b.endswith("iv") else trim(b, ["os", "ic", "ad"], p2)
        if s in P.AGENT:
            return b + "ir" if len(b) >= pv and b.endswith("e") else w
        more = {"mente": ["ante", "avel", "ível"], "idad": ["abil", "ic", "iv"]}
        return (trim(b, next((m for k, m in more.items() if s.startswith(k)), ["at"]), p2)) if in2 else w
    out = standard()
    if out == w:
        s = longest(w[pv:], P.VERBS)
        out = w[:len(w) - len(s)]
    if out != w:
        if out.endswith("ci") and len(out) - 1 >= pv:
            out = out[:-1]
    else:
        out = trim(out, P.RESIDUAL, pv)
    if out[-1:] in ("e", "é", "ê") and out:
        if len(out) - 1 >= pv:
            out = out[:-1]
            if out.endswith(("gu", "ci")) and len(out) - 1 >= pv:
                out = out[:-1]
    elif out.endswith("ç"):
        out = out[:-1] + "c"
    return out.replace("a~", "ã").replace("o~", "õ")


def stems(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    return {r["w"]: r["s"] for r in df.select("w", P.portuguese_stem(F.col("w")).alias("s")).collect()}


def test_published_sample(spark):
    pairs = dict(p.split() for line in SAMPLE.split("\n") for p in line.split("|") if p.strip())
    assert stems(spark, pairs) == pairs and len(pairs) == 80


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_plain_form(spark, seed):
    import random
    rnd = random.Random(seed)
    every = [*P.DELETED, *[s for g in P.REPLACED.values() for s in g], *P.ADVERB, *P.MANNER, *P.QUALITY, *P.KIND, *P.AGENT,
             *P.VERBS, *P.RESIDUAL, "ativamente", "ativa", "abilidade", "antemente", "eira", "cia", "ague", "ace", "ç", "ões"]
    letters = "aeioubcdglmnrstvçáéêãõ"
    words = {"".join(rnd.choices(letters, k=rnd.randint(0, 7))) + rnd.choice(every).replace("a~", "ã").replace("o~", "õ")
             for _ in range(3000)} | {"", "a", "ã", "é", "bé", "os"}
    assert stems(spark, words) == {w: plain_stem(w) for w in words}


def test_words_that_no_step_changes_are_told_by_their_last_letter(spark):
    import random
    import unicodedata
    rnd, letters = random.Random(3), [c for c in map(chr, range(0x61, 0x180)) if unicodedata.category(c) == "Ll"]
    assert set(P.ENDINGS) == set("aeilmorsuáçéêíó")
    words = {"".join(rnd.choices("aeiouãbcglt", k=rnd.randint(0, 6))) + c for c in letters for _ in range(20)}
    assert stems(spark, words) == {w: plain_stem(w) for w in words}
    assert all(plain_stem(w) == w for w in words if w[-1] not in P.ENDINGS)


def test_null_and_decomposed_letters(spark):
    row = spark.range(1).select(P.portuguese_stem(F.lit(None).cast("string")).alias("n"), P.composed(
        F.lit("licitação É plain")).alias("c")).first()
    assert row["n"] is None and row["c"] == "licitação É plain"
