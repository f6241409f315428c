import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.operators import codecs
from brindle.operators.registry import CODERS
from brindle.sources.wav import from_wav, to_wav

samples = st.lists(st.integers(-(2**20), 2**20), max_size=80)


def test_known_values():
    x = np.array([0, -1, 3, -4, 7, -12])
    z = codecs.zigzag(x)
    assert z.tolist() == [0, 1, 6, 7, 14, 23]
    assert codecs.unzigzag(z).tolist() == x.tolist()
    assert codecs.rice_encode(z, 2).hex() == "06afafb0"


@pytest.mark.parametrize("name", sorted(CODERS))
@settings(deadline=None, max_examples=40)
@given(x=samples)
def test_coders_are_lossless(name, x):
    encode, decode = CODERS[name]
    z = codecs.zigzag(np.array(x, np.int64))
    assert decode(encode(z), len(z)).tolist() == z.tolist()


@settings(deadline=None, max_examples=40)
@given(x=samples)
def test_lpc_and_containers_are_lossless(x):
    x = np.array(x, np.int64)
    code = codecs.lpc_encode(x)
    assert codecs.lpc_decode(codecs.unpack_container(codecs.pack_container([code]))[0]).tolist() == x.tolist()


@settings(deadline=None, max_examples=60)
@given(data=st.binary(max_size=300))
def test_arithmetic_coder_is_lossless(data):
    assert codecs.arithmetic_decode(codecs.arithmetic_encode(data), len(data)) == data


def test_levinson_solves_the_normal_equations():
    r = np.array([4.0, 2.0, 0.5, 0.1])
    a = codecs.levinson(r, 3)
    assert np.allclose(np.array([[r[abs(i - j)] for j in range(3)] for i in range(3)]) @ a, r[1:])


def test_wav_round_trip():
    rate, channels, back = from_wav(to_wav([0, -5, 32767, -32768], 8000))
    assert (rate, channels, back.tolist()) == (8000, 1, [0, -5, 32767, -32768])
