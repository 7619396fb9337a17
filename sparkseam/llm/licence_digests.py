"""Digests, of the form of licences.canonical(), of long licence texts: those of /usr/share/common-licenses, those that have one also
without their appendix (with and without its last line, "END OF TERMS AND CONDITIONS"), and the Unlicense with and without its last line."""

DIGESTS = (
    ("c31bf82a0b158dd6ea2ad8c987b1c953510e14860c1ce36ef70c57b89af26941", "Apache-2.0"),
    ("7fa44a938f88545a14afe2f454ba8f878375d669a8b502076e6da59046e1006a", "Apache-2.0"),
    ("ad43d8eef0ef003ab5b95192337af3cec3e9d56fceaf1701f54ebb7cc864a09c", "Apache-2.0"),
    ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "CC0-1.0"),
    ("37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f", "GPL-1.0-only"),
    ("4575f8cf583cfe5694de121df7d28ae3c2043234ee2357a6bc38c20fc1856cf0", "GPL-1.0-only"),
    ("3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9", "GPL-1.0-only"),
    ("ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6", "GPL-2.0-only"),
    ("611467176757b44c5c63b6b18b9b61a9e3d7bd13d738d6dde1cdce99fb1f12ef", "GPL-2.0-only"),
    ("a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0", "GPL-2.0-only"),
    ("ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8", "GPL-3.0-only"),
    ("7ffc4b405b2d22c9a01c3a22db88495dbca721fad42a69191637c049f0108153", "GPL-3.0-only"),
    ("4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b", "GPL-3.0-only"),
    ("43e9e891645f774ea0321c6d95b3d31fe844708b3ff3d029708b0041f7f47301", "LGPL-2.0-only"),
    ("cc86f115e5a5f6dd844884295d23f63efdb95d6fefe9cd94cdc7474eb3495efa", "LGPL-2.0-only"),
    ("19e50e44e585ea7dd587719dac4265b61d3314b00b23e54234062f9f1f00893f", "LGPL-2.0-only"),
    ("ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692", "LGPL-2.1-only"),
    ("9c2c2afdce244f7835e438f43966f864ce47d82ebd6316bbcb123927f3280e30", "LGPL-2.1-only"),
    ("65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97", "LGPL-2.1-only"),
    ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "LGPL-3.0-only"),
    ("a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b", "MPL-1.1"),
    ("f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a", "MPL-2.0"),
    ("33eed4796f79efcdaa89cde018b316f05fd069e0766391e36a91cc54cf949265", "GFDL-1.2-only"),
    ("6ff331feb9c41ea46f5cdb86d28b14db81917916ae98dd83f395720bb8b269ac", "GFDL-1.3-only"),
    ("d204941775ec7bcd689de0a18b9e348b6828c2e6004b77bab8baf847cd70cee5", "Artistic-1.0-Perl"),
    ("f507d73d343a3d7b0b7ecd39319f6c349b515eeed80b814918af61cdac69e4a5", "Unlicense"),
    ("e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229", "Unlicense"),
)
