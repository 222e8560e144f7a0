"""What an answer may say: terms that are rewritten, notices before it, disclaimers after it, and when it abstains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablarium.functions.text import let, match_spans, tr_fold, tr_fold_ascii, tr_upper
from tablarium.operators.answers import soft_terms, states_rate

#: Stems of terms that are rewritten, the forms that stay, what stands for each form, and phrases of a contrast (folded).
FORBIDDEN, ALLOWED = "(?U)\\b(?:faiz|interest)\\w*", "^faizsiz"
PLAIN = {
    "faiz": "kâr payı", "faizi": "kâr payı", "faizin": "kâr payının", "faizini": "kâr payını", "faize": "kâr payına", "faizden": "kâr payından",
    "faizle": "kâr payıyla", "faizli": "kâr paylı", "faizler": "kâr payları", "faizleri": "kâr payları", "faizlerin": "kâr paylarının", "interest": "kâr payı",
}
CONTRASTED = {
    "faiz": "konvansiyonel getiri", "faizi": "konvansiyonel getiriyi", "faizin": "konvansiyonel getirinin", "faizini": "konvansiyonel getirisini",
    "faize": "konvansiyonel getiriye", "faizden": "konvansiyonel getiriden", "faizle": "konvansiyonel getiriyle", "faizli": "konvansiyonel",
    "faizler": "konvansiyonel getiriler", "faizleri": "konvansiyonel getiriler", "faizlerin": "konvansiyonel getirilerin", "interest": "konvansiyonel getiri",
}
CONTRAST = "arasindaki fark|farki nedir|fark nedir|aksine|yerine|kiyasla|karsin|oysa|degildir|degil mi|farkli olarak|ayrimi"
#: Texts that stand for an answer, before it and after it.
RULING_REPLY = (
    "Bu bir **fıkhî hüküm** sorusudur ve bu sistem hüküm vermez — ne olumlu ne olumsuz.\n\nBağlayıcı görüş için yetkili merciler:\n"
    "- **TKBB (Türkiye Katılım Bankaları Birliği) Danışma Kurulu** — sektör genelinde bağlayıcı standart kararları yayımlar.\n"
    "- **İlgili bankanın kendi danışma komitesi** — o bankanın ürününe özgü görüşü verir.\n\n"
    "Ben yalnızca olgusal bilgi sunabilirim: kâr payı oranı, vade, tutar, taksit, tahsis ücreti ve masraf durumu."
)
OUT_OF_SCOPE = (
    "Bu soru elimdeki verinin kapsamı dışında — **bilmiyorum**, tahmin etmiyorum.\n\nYanıtlayabildiğim alan: katılım bankalarının kampanya metinlerinden "
    "çıkarılmış kâr payı oranı, vade, finansman tutarı, taksit sayısı, tahsis ücreti ve masraf durumu bilgileri."
)
NO_SOURCE = (
    "Bu bilgi verimde **yok**. Uydurmak yerine bilmediğimi belirtiyorum; kaynağa dayanmayan bir değer üretmem.\n\n"
    "Sorunuzu farklı bir banka, ürün ya da alan için tekrar sorabilirsiniz."
)
NOTICES = {
    "terminology": (
        "Not: Katılım bankacılığı faizsizdir; konvansiyonel bankacılıktaki oranın karşılığı burada **kâr payı oranı**dır ve kâr-zarar paylaşımına dayanır. "
        "Sorunuzu kâr payı oranı olarak yanıtlıyorum."
    ),
    "advice": "Tavsiye vermiyorum; bunun yerine karşılaştırmalı olguları sunuyorum.",
    "guarantee": (
        "Önce ilkeyi netleştirelim: katılım bankacılığında **getiri garanti edilmez**. Katılma hesabı kâr-zarar paylaşımına dayanır; ilan edilen kâr payı oranı "
        "beklenen ya da geçmişte gerçekleşmiş orandır, sabit bir taahhüt değildir."
    ),
}
DISCLAIMERS = {
    "advice": "_Not: Bu bir **yatırım tavsiyesi değildir**. Sistem yalnızca karşılaştırmalı olguları sunar, banka tercihi yapmaz; karar ve sorumluluk size aittir._",
    "guarantee": (
        "_Not: Kâr payı oranı **beklenen / gerçekleşmiş** bir orandır, taahhüt edilmiş getiri değildir. Katılma hesapları kâr **ve zarara** ortak olur; "
        "oran garanti anlamı taşımaz._"
    ),
}
_AROUND = 30


def _cased(original: Column, new: Column) -> Column:
    """new in the case of the original: all capitals, a capital at its beginning, or as it is."""
    upper = (original == tr_upper(original)) & (original != tr_fold(original))
    first = F.substring(original, 1, 1)
    begins = (first == tr_upper(first)) & (first != tr_fold(first))
    return F.when(upper & (F.length(original) > 1), tr_upper(new)).when(begins, F.concat(tr_upper(F.substring(new, 1, 1)), F.substring(new, 2, 1000))).otherwise(new)


def _meant(token: Column, contrast: Column) -> Column:
    of = lambda table, other: F.coalesce(*[F.when(token == k, v) for k, v in table.items()], F.lit(other))
    return F.when(contrast, of(CONTRASTED, "konvansiyonel getiri")).otherwise(of(PLAIN, "kâr payı"))


def sanitize(answer: Column) -> Column:
    """QA16: struct text, violations: words of interest are rewritten in their place, in their case and as the whole text means them.

    A text whose folded form has other places is only marked: its violations have no replacement. A text that contrasts kinds of banking speaks of conventional returns, any other of profit shares. Forms for the absence of
    interest stay. violations: array of structs term (folded), replacement, contrast, context (30 characters around). Null: empty.
    """

    def rewritten(x: Column) -> Column:
        t, spans, contrast = x["t"], x["spans"], x["contrast"]

        def part(k: Column) -> Column:
            """The text between the match before the k-th and the k-th, and what the k-th becomes."""
            s, start = F.get(spans, k), F.coalesce(F.get(spans, k - 1)["e"], F.lit(0))
            original = F.substring(t, s["s"] + 1, s["e"] - s["s"])
            return F.concat(F.substring(t, start + 1, s["s"] - start), _cased(original, _meant(s["m"], contrast)))

        def told(s: Column) -> Column:
            begin = F.greatest(s["s"] - _AROUND, F.lit(0))
            context = F.substring(t, begin + 1, s["e"] + _AROUND - begin)
            return F.struct(s["m"].alias("term"), _meant(s["m"], contrast).alias("replacement"), contrast.alias("contrast"), context.alias("context"))

        last = F.coalesce(F.get(spans, F.size(spans) - 1)["e"], F.lit(0))
        numbers = F.when(F.size(spans) > 0, F.sequence(F.lit(0), F.size(spans) - 1)).otherwise(F.array().cast("array<int>"))
        text = F.concat(F.array_join(F.transform(numbers, part), ""), F.substring(t, last + 1, F.length(t)))
        marked = F.struct(t.alias("text"), F.transform(F.slice(spans, 1, 1), lambda s: F.struct(s["m"].alias("term"), nothing.alias("replacement"), contrast.alias("contrast"), nothing.alias("context"))).alias("violations"))
        return F.when(x["moved"], marked).otherwise(F.struct(text.alias("text"), F.transform(spans, told).alias("violations")))

    nothing = F.lit(None).cast("string")

    def known(t: Column) -> Column:
        spans = F.filter(match_spans(tr_fold(t), FORBIDDEN), lambda s: ~s["m"].rlike(ALLOWED))
        return F.struct(t.alias("t"), spans.alias("spans"), tr_fold_ascii(t).rlike(CONTRAST).alias("contrast"), (F.length(tr_fold(t)) != F.length(t)).alias("moved"))

    return let(let(F.coalesce(answer, F.lit("")), known), rewritten)


def guard(body: Column, gates: Column, has_sources: Column, has_rate: Column) -> Column:
    """QA17: struct answer, gates, abstained, violations, soft_terms.

    gates: those that the question met (answers.gates). A question for a ruling, or out of scope, gets a fixed reply; a body without
    sources gives way to an abstention. Notices of the gates stand before the rewritten body, disclaimers after it, and an answer
    that states a rate ends with the one on guarantees.
    """

    def made(x: Column) -> Column:
        g = x["gates"]
        met = lambda name: F.array_contains(g, name)
        outside, ruling = met("abstention"), met("ruling")
        abstained = outside | (~ruling & ~F.coalesce(has_sources, F.lit(False)))
        said = F.when(ruling, RULING_REPLY).when(outside, OUT_OF_SCOPE).when(abstained, NO_SOURCE).otherwise(body)
        return let(sanitize(said), lambda clean: final(g, met, abstained, said, clean))

    def final(g: Column, met, abstained: Column, said: Column, clean: Column) -> Column:
        rated = (has_rate | states_rate(clean["text"])) & ~abstained & ~met("ruling")
        parts = [F.when(met(k), t) for k, t in NOTICES.items()] + [clean["text"], F.when(met("advice"), DISCLAIMERS["advice"]), F.when(met("guarantee") | rated, DISCLAIMERS["guarantee"])]
        more = F.array_compact(F.array(F.when(abstained & ~met("abstention"), "abstention"), F.when(rated & ~met("guarantee"), "guarantee")))
        return F.struct(
            F.array_join(F.filter(F.array_compact(F.array(*parts)), lambda p: p != ""), "\n\n").alias("answer"), F.concat(g, more).alias("gates"), abstained.alias("abstained"),
            clean["violations"].alias("violations"), soft_terms(said).alias("soft_terms"),
        )

    return let(F.struct(gates.alias("gates")), made)
