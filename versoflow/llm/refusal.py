"""Whether a reply declines its task: a naive Bayes classifier of words, fitted for each language.

It is fitted on the example sentences below, which decline a task, and on a bounded sample of prompts and the sentences of
known language, which don't.
Words are Latin words, runs of kana and pairs of neighbouring Han characters; what counts is whether a word is in a reply. A word speaks
for a refusal only if an example has it; a word that no example and no prompt has speaks a little against one.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versoflow.llm.cutting import HAN, Cut, paired
from versoflow.llm.sampling import by_hash

#: Prompts of the corpus that the classifier is fitted on, at most, and their characters.
SAMPLE, LONGEST = 4000, 2000
#: Weight of a word met nowhere; smoothing; log-odds of a refusal before any word.
UNMET, SMOOTH, PRIOR = -0.3, 0.2, -5.0

#: Training examples: replies that decline a task.
EXAMPLES = {
    "en": [
        "I'm sorry, but I can't translate this text.", "I cannot help with that request.", "I will not do this.", "As a language model I do not produce translations of this kind.",
        "Unfortunately I am not able to process this passage.", "I must decline to render this content.", "I won't translate that.", "This request is not something I can assist with.",
        "I apologise, however I have to refuse this task because it may violate policy.", "Sorry, I am unable to work on this material; it touches on sensitive content.",
        "I don't feel comfortable translating this excerpt.", "I have to be honest: I can't provide a rendering of the passage. Please send a different text.",
        "As an AI assistant, I am not allowed to handle such content.", "I refuse to complete this request. I could summarise it instead if you like.", "After looking at the text, I can’t comply.",
        "It is not possible for me to fulfil this request.",
    ],
    "de": [
        "Es tut mir leid, aber ich kann diesen Text nicht übersetzen.", "Das mache ich nicht.", "Leider kann ich bei dieser Anfrage nicht helfen.", "Diese Anfrage muss ich ablehnen.",
        "Als Sprachmodell erstelle ich keine Übersetzungen dieser Art.", "Ich darf diesen Inhalt nicht bearbeiten.", "Ich kann diese Passage leider nicht verarbeiten, da sie gegen Richtlinien verstoßen könnte.",
        "Das werde ich nicht übersetzen.", "Ich bitte um Verständnis, dabei kann ich nicht behilflich sein.", "Bitte senden Sie eine andere Textstelle, diese kann ich nicht übertragen.",
        "Ich bin nicht in der Lage, diesen Abschnitt zu übersetzen.", "Entschuldigung, diese Aufgabe kann ich nicht erledigen.", "Ehrlich gesagt möchte ich diesen Text nicht bearbeiten. Gern fasse ich ihn zusammen.",
        "Als KI-Assistent ist mir das nicht erlaubt.", "Ich weigere mich, diesen Auftrag auszuführen, weil der Inhalt heikel ist.", "Nach Durchsicht der Stelle muss ich die Bitte ablehnen.",
    ],
    "fr": [
        "Je suis désolé, mais je ne peux pas traduire ce texte.", "Je ne le ferai pas.", "Malheureusement, je ne suis pas en mesure de vous aider pour cette demande.", "Je dois décliner cette demande.",
        "En tant que modèle de langage, je ne produis pas ce genre de traductions.", "Je refuse de traiter ce contenu.", "Il m'est impossible de traiter ce passage, car il pourrait enfreindre les règles.",
        "Je ne traduirai pas cela.", "Veuillez m'excuser, je ne peux pas accomplir cette tâche.", "Merci d'envoyer un autre passage, je ne peux pas travailler sur celui-ci.",
        "Je ne suis pas autorisé à fournir cette traduction.", "Après lecture du passage, je dois refuser.", "Pour être honnête, je ne souhaite pas traduire cet extrait. Je pourrais le résumer.",
        "Désolé, je ne peux pas répondre à cette requête.", "Ce contenu est sensible et je préfère ne pas le traduire.", "En tant qu'assistant, je ne peux pas aider avec ce texte.",
    ],
    "es": [
        "Lo siento, pero no puedo traducir este texto.", "No voy a hacer eso.", "Lamentablemente no puedo ayudarle con esta solicitud.", "Debo rechazar esta petición.",
        "Como modelo de lenguaje, no produzco traducciones de este tipo.", "Me niego a procesar este contenido.", "No me es posible trabajar con este fragmento, ya que puede infringir las normas.",
        "No traduciré esto.", "Disculpe, no puedo realizar esta tarea.", "Por favor, envíe otro pasaje; este no lo puedo procesar.", "No estoy autorizado a ofrecer esta traducción.",
        "Tras leer el pasaje, tengo que declinar la solicitud.", "Sinceramente, prefiero no traducir este extracto. Podría resumirlo.", "Perdón, no puedo cumplir con la petición.",
        "Este material es delicado y no puedo ayudar con él.", "Como asistente, no puedo atender este texto.",
    ],
    "zh": [
        "很抱歉，我无法翻译这段文字。", "我做不到。", "对不起，我不能帮助处理这个请求。", "我必须拒绝这个请求。", "作为语言模型，我不提供这类翻译。", "这段内容我没有办法处理，因为可能违反规定。", "我不会翻译这个。",
        "不好意思，我不便协助这项任务。", "请换一段文字，这一段我无法翻译。", "我不被允许处理此类内容。", "看过这段内容之后，我只能拒绝。", "说实话，我不愿意翻译这段文本，我可以概述大意。",
        "抱歉，我无法完成您的要求。", "内容敏感，恕我不能翻译。", "非常遗憾，我不能提供译文。", "作为人工智能助手，我无法满足这个请求。",
    ],
    "ja": [
        "申し訳ありませんが、この文章は翻訳できません。", "それはできません。", "残念ながら、このご依頼にはお手伝いできません。", "このリクエストはお断りします。", "言語モデルとして、このような翻訳は行いません。",
        "この内容は規定に反する可能性があるため、処理できません。", "これは訳しません。", "恐れ入りますが、この作業には対応できかねます。", "別の文章をお送りください。こちらは翻訳いたしかねます。",
        "このような内容を扱うことは許可されていません。", "内容を確認しましたが、お断りしなければなりません。", "正直なところ、この一節の翻訳は控えたいです。要約なら可能です。", "すみません、ご要望にはお応えできません。",
        "機密性の高い内容のため、翻訳を提供できません。", "この箇所を訳すことは私にはできません。", "アシスタントとして、このテキストには対応できません。",
    ],
}


def _words(cut: Cut) -> tuple[np.ndarray, np.ndarray]:
    """Text and key of each word, of texts cut into single Han characters."""
    han = cut.script == HAN
    joins = han[1:] & han[:-1] & (cut.begin[1:] == cut.stop[:-1])
    before, after = np.concatenate(([False], joins)), np.concatenate((joins, [False]))[: len(han)]
    key = cut.key.copy()
    at = np.flatnonzero(after)
    key[at] = paired(cut.key[at], cut.key[at + 1])
    keep = after | ~before[: len(han)]
    return cut.doc[cut.sentence][keep], key[keep]


def _present(texts: list[str]) -> list[set[int]]:
    """Keys of the words of each text."""
    doc, key = _words(Cut(texts, han=1))
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [set(key[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]


def fit(segments: DataFrame, sentences: list[tuple[str, str]], langs_of) -> tuple[np.ndarray, np.ndarray]:
    """Words and their weights, ascending by word. ``langs_of`` gives the languages of texts; at most SAMPLE prompts are read.
    ``sentences`` of known languages are held against the examples too."""
    rows = segments.where(F.char_length("original_text").between(1, LONGEST)).select("row_id", "original_text")
    return weights([r.original_text for r in by_hash(rows, SAMPLE, "row_id", "original_text").collect()], sentences, langs_of)


def weights(prompts: list[str], sentences: list[tuple[str, str]], langs_of) -> tuple[np.ndarray, np.ndarray]:
    """Weights by language of the words, in the order of keys. Words of several languages get their mean weight."""
    languages = [*(langs_of(prompts) if prompts else []), *(lang for lang, _ in sentences)]
    prompts = [*prompts, *(text for _, text in sentences)]
    found: dict[int, list[float]] = {}
    for lang, examples in EXAMPLES.items():
        refused, others = Counter(), Counter()
        for words in _present(examples):
            refused.update(words)
        mine = [p for p, x in zip(prompts, languages) if x == lang]
        for words in _present(mine):
            others.update(words)
        for word in refused.keys() | others.keys():
            a = (refused[word] + SMOOTH) / (len(examples) + 2 * SMOOTH)
            b = (others[word] + SMOOTH) / (max(len(mine), 10 * len(examples)) + 2 * SMOOTH)
            weight = math.log(a / b)
            found.setdefault(word, []).append(weight if refused[word] else min(0.0, weight))
    keys = np.array(sorted(found), dtype=np.uint64)
    return keys, np.array([float(np.mean(found[int(k)])) for k in keys])


class Refusals:
    """Log-odds of a refusal for the replies of a batch."""

    def __init__(self, weights: tuple[np.ndarray, np.ndarray]) -> None:
        self.keys, self.weights = weights

    def log_odds(self, cut: Cut) -> np.ndarray:
        """From the distinct words of each text; texts without words have the prior."""
        doc, key = _words(cut)
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        once = np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=bool)
        doc, key = doc[once], key[once]
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        weight = np.where(self.keys[at] == key, self.weights[at], UNMET) if len(self.keys) else np.full(len(key), UNMET)
        return PRIOR + np.bincount(doc, weight, minlength=cut.docs)
