"""SHA-256 of the canonical form of whole public licence texts, by identifier."""

from __future__ import annotations

from collections.abc import Mapping

# Texts with and, where they have one, without the appendix after their terms.
TEXT_DIGESTS: Mapping[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2",
        "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0",
    ),
    "Artistic-1.0-Perl": (
        "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a",
    ),
    "CC0-1.0": (
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ),
    "GFDL-1.2-only": (
        "bd8e32052e49e6b79fccbdd5dc03f7d40e45a8e895e3ecb79394b97961ffb127",
    ),
    "GFDL-1.3-only": (
        "e7579a53c7b8214f091590d94bfe39deb978a080895ca5506448b8baf4f77985",
    ),
    "GPL-1.0-only": (
        "e08c08387b3e9d9292a19e7b8b719bc2420466e91f96235d7addba9279c91199",
        "6c07dfb5e6ddc39fe93ae803d39b67367c21b50207b645111c04cd08cb283d70",
    ),
    "GPL-2.0-only": (
        "c9150a998ddbe45123303bf71d093beee4baf803b1eaea84b34fd41189285f1f",
        "f79b9e516923cc213c21d12fd8a51b4067992b2728a442e31fd53d078dd25632",
    ),
    "GPL-3.0-only": (
        "0aaa86fd25a52aa4d43fba9feecd7c73f21a0b232037da11fedeabd5babb7cd7",
        "a24af1212033c750181dd5fd1b237d77861cfbccee7d8ddbc36472ddc57fc2be",
    ),
    "LGPL-2.0-only": (
        "59a061c498ef1c6b3fd9ad6466d69d12b400f64b87cb827d62c381d3bc6aca88",
        "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389",
    ),
    "LGPL-2.1-only": (
        "1f0770d1499d1ef2c69208a3369d7d9f7722ab5c39fbad959327bed318feb554",
        "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97",
    ),
    "LGPL-3.0-only": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-1.1": (
        "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986",
    ),
    "MPL-2.0": (
        "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    ),
}
