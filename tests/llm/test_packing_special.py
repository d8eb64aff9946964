"""Texts that spell special tokens get the tokenizer's own ids."""

from tokenizers import Tokenizer

from partloom.llm import packing


def test_special_tokens():
    plain = Tokenizer.from_file(packing.TOKENIZER)
    texts = ["hi <|endoftext|> there", "a<|startoftext|>b, c.", "Hi <|ENDOFTEXT|> x", "<|endoftext|>", "hi <| endoftext |> there", "plain text."]
    got = packing.Encoder(packing.TOKENIZER).encode([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [[*plain.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]
    assert got[0].tolist()[:-1] == [1883, 49407, 997]
