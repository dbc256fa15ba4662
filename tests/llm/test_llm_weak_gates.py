"""The long expressions for threats and abuse find the same with their gates as without."""

from __future__ import annotations

import duckdb
import pytest

from mnemolake.llm import weak_quality as wq

HITS = [
    "I will kill you", "I’m gonna FIND you!", "(kill yourself)", "go die", "You deserve to die.", "Ich bring dich um", "ich mache dich kalt",
    "je vais te buter", "crève donc", "tu vas mourir", "te voy a pegar", "Mátate", "muérete", "vas a morir", "I WİLL KİLL you", "I will kıll you",
    "x-kill yourself", "you're such a bore", "you are nothing but air", "you are a total bore", "you little thing", "what an utter mess you are",
    "shut the door up", "ſhut up", "nobody likes your hat", "go to hello", "get losted", "screw you", "du bist echt eine", "Du Elendiger Wicht",
    "halt die Fresse", "geh zur Hölle", "verpiss dich", "espèce d'oie", "espèces de noix", "tu n'es qu'une", "tu es une grosse", "ferme-la", "ta gueules",
    "va te faire", "pedazo de pan", "trozo de pan", "no eres más que", "eres una total", "¡cállateya", "vete al diablo",
]


@pytest.mark.parametrize("text", HITS)
def test_gate_lets_every_form_through(text):
    assert wq._THREATS.search(text) or wq._ABUSE.search(text)
    votes = wq.Features().votes(text)["toxic"]
    assert votes[-3] == (wq.BAD if wq._THREATS.search(text) else wq.NONE)
    assert votes[-2] == (wq.BAD if wq._ABUSE.search(text) else wq.NONE)


def test_gates_on_a_table():
    features = wq.Features()
    for (text,) in duckdb.sql("SELECT coalesce(text, '') FROM '/root/testdata/sf0.01/documents.parquet'").fetchall():
        votes = features.votes(text)["toxic"]
        assert (votes[-3] == wq.BAD) == bool(wq._THREATS.search(text))
        assert (votes[-2] == wq.BAD) == bool(wq._ABUSE.search(text))


def test_words_that_come_again_after_the_memory_is_cleared(monkeypatch):
    monkeypatch.setattr(wq, "CACHE_WORDS", 3)
    features, fresh = wq.Features(), "You are such a fool , fool Fool !"
    want = wq.Features().votes(fresh)
    for other in ("one two three four five", "", "six seven"):
        features.votes(other)
        assert features.votes(fresh) == want
