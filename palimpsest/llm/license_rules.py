"""Signature rules of license scans, one per line: label, priority, keywords, pattern.

A pattern is a regular expression over words (lower case, one space between them).  Its
keywords (joined by ``&``, ``_`` for a space) stand in every text that it matches, so a
rule is tried only where all of them do.  ``<V>`` is a verb of licensing, ``<L>`` either
spelling of license, ``<O>`` an optional "or later", ``<T>`` an optional article with or without
"terms of".  Priorities: 100 tags, 95 sentences of the license itself, 90 grants, 80 references,
70 names, 60 fields, 50 addresses, 40 mentions.
"""

from __future__ import annotations

PARTS = {
    "<V>": "(?:licensed|released|distributed|available|provided|published|covered|shared|issued|offered)",
    "<L>": "licen[sc]e",
    "<O>": "(?: (?:only|or (?:any |at your option any )?(?:later|newer)(?: version)?))?",
    "<T>": "(?:the )?(?:terms of (?:the )?)?",
}

RULES = r"""
mit 100 identifier&mit spdx license identifier mit
mit 95 hereby&obtaining permission is hereby granted free of charge to any person obtaining a copy of this software
mit 95 restriction&sublicense without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit 90 under&mit <V> under <T>mit(?: x11| expat)?(?: <L>)?
mit 80 mit_licen (?:under|see|per|via) the mit <L>
mit 80 terms&mit terms of the mit(?: <L>)?
mit 70 mit_licen mit licen[sc]ed?
mit 70 mit_x11 mit x11(?: <L>)?
mit 70 expat_licen expat <L>
mit 60 licen&_mit <L> mit
mit 60 licen&_mit <L> (?:is|type|name|text) mit
mit 50 opensource&mit opensource org licenses mit(?: license)?(?: php| html)?
mit-0 100 identifier&mit_0 spdx license identifier mit 0
mit-0 70 attribution&mit mit no attribution(?: <L>)?
apache-2 100 identifier&apache spdx license identifier apache 2 0
apache-2 95 compliance&apache you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org
apache-2 90 under&apache <V> under <T>apache(?: software)?(?: <L>)?(?: version)? v?2(?: 0)?(?: <L>)?
apache-2 80 apache&licen under the apache <L> v?2(?: 0)?
apache-2 80 apache&licen (?:under|see) the apache (?:version )?2(?: 0)? <L>
apache-2 70 apache&licen apache(?: software)? <L>(?: version| v)? ?2(?: 0)?
apache-2 70 apache&licen apache v?2(?: 0)? licen[sc]ed?
apache-2 70 asl_2 asl 2(?: 0)?
apache-2 60 licen&apache <L> apache(?: <L>)?(?: version)? v?2(?: 0)?
apache-2 60 licen&apache <L> (?:is|type|name) apache 2 0
apache-2 50 apache&licenses www apache org licenses license 2 0(?: txt| html)?
apache-1.1 100 identifier&apache spdx license identifier apache 1 1
apache-1.1 70 apache&licen apache(?: software)? <L>(?: version)? 1 1
apache-1.1 90 under&apache <V> under <T>apache(?: software)?(?: <L>)?(?: version)? 1 1
apache 80 apache&licen (?:under|see) the apache <L>
apache 70 apache_licen apache licen[sc]ed?
bsd-2-clause 100 identifier&bsd spdx license identifier bsd 2 clause
bsd-2-clause 90 under&bsd <V> under <T>(?:simplified bsd|bsd 2(?: clause)?|2 clause bsd|two clause bsd|freebsd)(?: <L>)?
bsd-2-clause 80 bsd&licen (?:under|see) the (?:simplified bsd|2 clause bsd|two clause bsd|bsd 2 clause) <L>
bsd-2-clause 70 bsd&licen (?:simplified bsd|freebsd|2 clause bsd|two clause bsd|bsd 2 clause) <L>
bsd-2-clause 60 licen&bsd <L> bsd 2 clause
bsd-2-clause 50 opensource&bsd opensource org licenses bsd 2 clause
bsd-3-clause 100 identifier&bsd spdx license identifier bsd 3 clause
bsd-3-clause 95 neither&contributors neither the name of the copyright holder nor the names of its contributors may be used to endorse
bsd-3-clause 90 under&bsd <V> under <T>(?:new bsd|revised bsd|modified bsd|bsd 3(?: clause)?|3 clause bsd|three clause bsd)(?: <L>)?
bsd-3-clause 80 bsd&licen (?:under|see) the (?:new bsd|revised bsd|modified bsd|3 clause bsd|three clause bsd|bsd 3 clause) <L>
bsd-3-clause 70 bsd&licen (?:new bsd|revised bsd|modified bsd|3 clause bsd|three clause bsd|bsd 3 clause) <L>
bsd-3-clause 60 licen&bsd <L> bsd 3 clause
bsd-3-clause 50 opensource&bsd opensource org licenses bsd 3 clause
bsd-4-clause 100 identifier&bsd spdx license identifier bsd 4 clause
bsd-4-clause 95 advertising&acknowledgement all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4-clause 90 under&bsd <V> under <T>(?:original bsd|bsd 4(?: clause)?|4 clause bsd|four clause bsd)(?: <L>)?
bsd-4-clause 70 bsd&licen (?:original bsd|4 clause bsd|four clause bsd|bsd 4 clause) <L>
0bsd 100 identifier&0bsd spdx license identifier 0bsd
0bsd 90 under&bsd <V> under <T>(?:zero clause bsd|0bsd|bsd zero clause)(?: <L>)?
0bsd 70 bsd&licen (?:zero clause bsd|0bsd|bsd zero clause) <L>
bsd 95 redistribution&binary redistribution and use in source and binary forms with or without modification are permitted
bsd 90 under&bsd <V> under <T>bsd(?: style)?(?: <L>)?
bsd 80 bsd&licen (?:under|see) the bsd(?: style)? <L>
bsd 70 bsd&licen bsd(?: style)? licen[sc]ed?
bsd 60 licen&bsd <L> bsd
isc 100 identifier&isc spdx license identifier isc
isc 95 permission&purpose permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 90 under&isc <V> under <T>isc(?: <L>)?
isc 80 isc&licen (?:under|see) the isc <L>
isc 70 isc&licen isc licen[sc]ed?
isc 60 licen&isc <L> isc
gpl-1 100 identifier&gpl spdx license identifier gpl 1 0(?: only| or later)?
gpl-1 90 under&gpl <V> under <T>(?:gnu )?gpl(?: version)? ?v?1(?: 0)?<O>
gpl-2 100 identifier&gpl spdx license identifier gpl 2 0(?: only| or later)?
gpl-2 95 redistribute&version redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
gpl-2 90 under&gpl <V> under <T>(?:gnu )?gpl(?: version)? ?v?2(?: 0)?<O>(?: <L>)?
gpl-2 90 under&general <V> under <T>gnu general public <L>(?: as published by the free software foundation)?(?: version| v)? ?2(?: 0)?<O>
gpl-2 80 gpl&2 (?:under|see) the (?:gnu )?gpl(?: version)? ?v?2(?: 0)?(?: <L>)?
gpl-2 70 general&public gnu general public <L>(?: version| v)? ?2(?: 0)?<O>
gpl-2 70 gpl&licen (?:gnu )?gpl(?: version)? ?v?2(?: 0)?<O> licen[sc]ed?
gpl-2 60 licen&gpl <L> (?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?
gpl-2 50 gnu&licenses www gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3 100 identifier&gpl spdx license identifier gpl 3 0(?: only| or later)?
gpl-3 95 redistribute&version redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
gpl-3 90 under&gpl <V> under <T>(?:gnu )?gpl(?: version)? ?v?3(?: 0)?<O>(?: <L>)?
gpl-3 90 under&general <V> under <T>gnu general public <L>(?: as published by the free software foundation)?(?: version| v)? ?3(?: 0)?<O>
gpl-3 80 gpl&3 (?:under|see) the (?:gnu )?gpl(?: version)? ?v?3(?: 0)?(?: <L>)?
gpl-3 70 general&public gnu general public <L>(?: version| v)? ?3(?: 0)?<O>
gpl-3 70 gpl&licen (?:gnu )?gpl(?: version)? ?v?3(?: 0)?<O> licen[sc]ed?
gpl-3 60 licen&gpl <L> (?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?
gpl-3 50 gnu&licenses www gnu org licenses gpl 3 0(?: html| txt)?
gpl 90 under&gpl <V> under <T>(?:gnu )?gpl(?: <L>)?
gpl 90 under&general <V> under <T>gnu general public <L>
gpl 80 terms&general terms of the gnu general public <L>
gpl 70 general&public gnu general public <L>
gpl 70 gpl&licen (?:gnu )?gpl licen[sc]ed?
gpl 60 licen&gpl <L> (?:is )?(?:gnu )?gpl
gpl 50 gnu&gpl www gnu org (?:licenses|copyleft) gpl(?: html| txt)?
lgpl-2 100 identifier&lgpl spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2 90 under&lgpl <V> under <T>(?:gnu )?lgpl(?: version)? ?v?2(?: 0)?<O>
lgpl-2 70 library&general gnu library general public <L>(?: version 2(?: 0)?)?
lgpl-2.1 100 identifier&lgpl spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 90 under&lgpl <V> under <T>(?:gnu )?lgpl(?: version)? ?v?2 1<O>
lgpl-2.1 90 under&lesser <V> under <T>gnu lesser general public <L>(?: version| v)? ?2 1<O>
lgpl-2.1 70 lesser&public gnu lesser general public <L>(?: version| v)? ?2 1<O>
lgpl-2.1 60 licen&lgpl <L> (?:gnu )?lgpl ?v?2 1(?: only| or later)?
lgpl-2.1 50 gnu&lgpl www gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-3 100 identifier&lgpl spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3 90 under&lgpl <V> under <T>(?:gnu )?lgpl(?: version)? ?v?3(?: 0)?<O>
lgpl-3 90 under&lesser <V> under <T>gnu lesser general public <L>(?: version| v)? ?3(?: 0)?<O>
lgpl-3 70 lesser&public gnu lesser general public <L>(?: version| v)? ?3(?: 0)?<O>
lgpl-3 60 licen&lgpl <L> (?:gnu )?lgpl ?v?3(?: 0)?(?: only| or later)?
lgpl 90 under&lgpl <V> under <T>(?:gnu )?lgpl(?: <L>)?
lgpl 70 lesser&public gnu lesser general public <L>
lgpl 70 lgpl&licen (?:gnu )?lgpl licen[sc]ed?
lgpl 60 licen&lgpl <L> (?:is )?(?:gnu )?lgpl
agpl-3 100 identifier&agpl spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 90 under&agpl <V> under <T>(?:gnu )?agpl(?: version)? ?v?3(?: 0)?<O>
agpl-3 90 under&affero <V> under <T>gnu affero general public <L>(?: version| v)? ?3(?: 0)?<O>
agpl-3 70 affero&public gnu affero general public <L>(?: version| v)? ?3(?: 0)?<O>
agpl-3 60 licen&agpl <L> (?:gnu )?agpl ?v?3(?: 0)?(?: only| or later)?
agpl-3 50 gnu&agpl www gnu org licenses agpl(?: 3 0)?(?: html| txt)?
agpl 90 under&agpl <V> under <T>(?:gnu )?agpl(?: <L>)?
agpl 70 affero&public gnu affero general public <L>
agpl 70 agpl&licen agpl licen[sc]ed?
fdl-1.3 100 identifier&gfdl spdx license identifier gfdl 1 3(?: only| or later)?
fdl-1.3 70 documentation&free gnu free documentation <L>(?: version)? 1 3
fdl-1.2 100 identifier&gfdl spdx license identifier gfdl 1 2(?: only| or later)?
fdl-1.2 70 documentation&free gnu free documentation <L>(?: version)? 1 2
fdl 90 under&documentation <V> under <T>gnu free documentation <L>
fdl 70 documentation&free gnu free documentation <L>
fdl 60 licen&gfdl <L> gfdl
mpl-1.1 100 identifier&mpl spdx license identifier mpl 1 1
mpl-1.1 90 under&mozilla <V> under <T>mozilla public(?: <L>)?(?: version| v)? ?1 1
mpl-1.1 70 mozilla&public mozilla public <L>(?: version| v)? ?1 1
mpl-2 100 identifier&mpl spdx license identifier mpl 2 0
mpl-2 95 subject&mozilla this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 90 under&mozilla <V> under <T>mozilla public(?: <L>)?(?: version| v)? ?2(?: 0)?
mpl-2 90 under&mpl <V> under <T>mpl(?: version)? ?v?2(?: 0)?
mpl-2 80 mpl&2 (?:under|see) the mpl ?v?2(?: 0)?
mpl-2 70 mozilla&public mozilla public <L>(?: version| v)? ?2(?: 0)?
mpl-2 60 licen&mpl <L> mpl ?v?2(?: 0)?
mpl-2 50 mozilla&mpl mozilla org mpl 2 0
mpl 70 mozilla&public mozilla public <L>
epl-1 100 identifier&epl spdx license identifier epl 1 0
epl-1 90 under&eclipse <V> under <T>eclipse public(?: <L>)?(?: version| v)? ?1(?: 0)?
epl-1 70 eclipse&public eclipse public <L>(?: version| v)? ?1(?: 0)?
epl-1 60 licen&epl <L> epl ?v?1(?: 0)?
epl-2 100 identifier&epl spdx license identifier epl 2 0
epl-2 90 under&eclipse <V> under <T>eclipse public(?: <L>)?(?: version| v)? ?2(?: 0)?
epl-2 70 eclipse&public eclipse public <L>(?: version| v)? ?2(?: 0)?
epl-2 60 licen&epl <L> epl ?v?2(?: 0)?
epl 70 eclipse&public eclipse public <L>
cddl-1 100 identifier&cddl spdx license identifier cddl 1 0
cddl-1.1 100 identifier&cddl spdx license identifier cddl 1 1
cddl-1 90 under&cddl <V> under <T>cddl(?: version)?(?: 1(?: 0)?)?(?: <L>)?
cddl-1 70 common&distribution common development and distribution <L>(?: cddl)?(?: version)?(?: 1 0)?
cddl-1 60 licen&cddl <L> cddl(?: 1 0)?
eupl-1.1 100 identifier&eupl spdx license identifier eupl 1 1
eupl-1.2 100 identifier&eupl spdx license identifier eupl 1 2
eupl-1.2 90 under&eupl <V> under <T>eupl(?: version)?(?: v?1 2)?
eupl-1.2 70 european&union european union public <L>(?: version| v)?(?: ?1 2)?
eupl-1.2 60 licen&eupl <L> eupl(?: v?1 2)?
artistic-1 100 identifier&artistic spdx license identifier artistic 1 0(?: perl| cl8)?
artistic-1 70 artistic&licen artistic <L>(?: version)? 1(?: 0)?
artistic-2 100 identifier&artistic spdx license identifier artistic 2 0
artistic-2 90 under&artistic <V> under <T>artistic(?: <L>)?(?: version)? 2(?: 0)?
artistic-2 70 artistic&licen artistic <L>(?: version)? 2(?: 0)?
artistic 90 under&artistic <V> under <T>(?:perl )?artistic <L>
artistic 70 artistic&licen (?:perl )?artistic <L>
perl 80 same&perl under the same terms as perl itself
boost-1 100 identifier&bsl spdx license identifier bsl 1 0
boost-1 90 under&boost <V> under <T>boost(?: software)?(?: <L>)?(?: version)?(?: 1(?: 0)?)?
boost-1 70 boost&licen boost(?: software)? <L>(?: version)?(?: 1(?: 0)?)?
boost-1 50 boost&license www boost org license 1 0(?: txt)?
busl-1.1 100 identifier&busl spdx license identifier busl 1 1
busl-1.1 70 business&source business source <L>(?: version)?(?: 1 1)?
zlib 100 identifier&zlib spdx license identifier zlib
zlib 95 provided&implied this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib 90 under&zlib <V> under <T>zlib(?: libpng)?(?: <L>)?
zlib 70 zlib&licen zlib(?: libpng)? licen[sc]ed?
zlib 60 licen&zlib <L> zlib
libpng 100 identifier&libpng spdx license identifier libpng(?: 2 0)?
libpng 70 libpng&licen libpng <L>
unlicense 100 identifier&unlicense spdx license identifier unlicense
unlicense 95 unencumbered&domain this is free and unencumbered software released into the public domain
unlicense 90 under&unlicense <V> under <T>unlicense(?: <L>)?
unlicense 80 the_unlicense (?:under|see|using) the unlicense
unlicense 60 licen&unlicense <L> (?:the )?unlicense
unlicense 50 unlicense_org unlicense org
wtfpl 100 identifier&wtfpl spdx license identifier wtfpl
wtfpl 90 under&wtfpl <V> under <T>wtfpl(?: <L>)?(?: version 2)?
wtfpl 70 what&want do what the f[a-z]* you want to public <L>
wtfpl 60 licen&wtfpl <L> wtfpl
psf-2 100 identifier&psf spdx license identifier psf 2 0
python-2 100 identifier&python spdx license identifier python 2 0(?: 1)?
psf-2 90 under&python <V> under <T>python(?: software foundation)? <L>
psf-2 70 python&licen python software foundation <L>(?: version 2)?
psf-2 60 licen&psf <L> psf(?: 2)?
ms-pl 100 identifier&ms_pl spdx license identifier ms pl
ms-pl 90 under&microsoft <V> under <T>microsoft public <L>(?: ms pl)?
ms-pl 70 microsoft&public microsoft public <L>
ms-pl 60 licen&ms_pl <L> ms pl
ms-rl 100 identifier&ms_rl spdx license identifier ms rl
ms-rl 70 microsoft&reciprocal microsoft reciprocal <L>
ofl-1.1 100 identifier&ofl spdx license identifier ofl 1 1
ofl-1.1 90 under&ofl <V> under <T>(?:sil )?ofl(?: version)?(?: 1 1)?
ofl-1.1 70 open&font (?:sil )?open font <L>(?: version)?(?: 1 1)?
ofl-1.1 60 licen&ofl <L> ofl(?: 1 1)?
ofl-1.1 50 scripts&ofl scripts sil org ofl
odbl-1 100 identifier&odbl spdx license identifier odbl 1 0
odbl-1 90 under&odbl <V> under <T>odbl(?: version)?(?: 1(?: 0)?)?
odbl-1 70 open&database open database <L>
odbl-1 60 licen&odbl <L> odbl(?: 1 0)?
odc-by 100 identifier&odc spdx license identifier odc by 1 0
odc-by 70 open&attribution open data commons attribution <L>
pddl-1 100 identifier&pddl spdx license identifier pddl 1 0
pddl-1 70 domain&dedication (?:open data commons )?public domain dedication and <L>
postgresql 100 identifier&postgresql spdx license identifier postgresql
postgresql 70 postgresql&licen postgresql <L>
openssl 100 identifier&openssl spdx license identifier openssl
openssl 70 openssl&licen openssl <L>
php-3 100 identifier&php spdx license identifier php 3 0(?: 1)?
php-3 70 php&licen php <L>(?: version)?(?: 3(?: 0)?1?)?
ruby 100 identifier&ruby spdx license identifier ruby
ruby 70 ruby&licen ruby <L>
vim 100 identifier&vim spdx license identifier vim
vim 70 vim&licen vim <L>
x11 100 identifier&x11 spdx license identifier x11
x11 70 x11&licen x11 <L>
ncsa 100 identifier&ncsa spdx license identifier ncsa
ncsa 90 under&ncsa <V> under <T>(?:university of illinois )?ncsa(?: open source)?(?: <L>)?
ncsa 70 illinois&ncsa university of illinois ncsa open source <L>
cecill-2.1 100 identifier&cecill spdx license identifier cecill 2 1
cecill-2.1 90 under&cecill <V> under <T>cecill(?: version)?(?: 2 1)?
cecill 70 cecill&licen cecill(?: [abc])? <L>
afl-3 100 identifier&afl spdx license identifier afl 3 0
afl-3 70 academic&free academic free <L>(?: version)?(?: 3(?: 0)?)?
osl-3 100 identifier&osl spdx license identifier osl 3 0
osl-3 70 open&software open software <L>(?: version)?(?: 3(?: 0)?)?
cpl-1 100 identifier&cpl spdx license identifier cpl 1 0
cpl-1 70 common&public common public <L>(?: version)?(?: 1 0)?
ipl-1 70 ibm&public ibm public <L>(?: version)?(?: 1 0)?
apsl-2 70 apple&public apple public source <L>(?: version)?(?: 2 0)?
qpl-1 70 public&licen q public <L>(?: version)?(?: 1 0)?
sspl-1 100 identifier&sspl spdx license identifier sspl 1 0
sspl-1 70 server&side server side public <L>(?: version)?(?: 1)?
elastic-2 100 identifier&elastic spdx license identifier elastic 2 0
elastic-2 70 elastic&licen elastic <L>(?: version)?(?: 2(?: 0)?)?
mulan-psl-2 100 identifier&mulan spdx license identifier mulanpsl 2 0
mulan-psl-2 70 mulan&permissive mulan permissive software <L>(?: version| v)?(?: ?2)?
beerware 100 identifier&beerware spdx license identifier beerware
beerware 70 beer&ware (?:the )?beer ?ware <L>
json 95 good&evil the software shall be used for good not evil
cc0 100 identifier&cc0 spdx license identifier cc0 1 0
cc0 90 under&cc0 <V> under <T>(?:creative commons )?cc0(?: 1 0)?(?: <L>)?
cc0 70 cc0&universal (?:creative commons )?cc0(?: 1 0| v1 0)? universal
cc0 70 zero&universal creative commons zero(?: 1 0| v1 0)? universal(?: cc0)?
cc0 60 licen&cc0 <L> (?:creative commons )?cc0(?: 1 0)?
cc0 50 creativecommons&zero creativecommons org publicdomain zero 1 0
cc-by 100 identifier&cc_by spdx license identifier cc by [1-4] 0
cc-by 90 under&cc_by <V> under <T>(?:a )?(?:creative commons )?cc by(?: [1-4] [05])?(?: <L>)?
cc-by 90 under&attribution <V> under <T>(?:a )?creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? <L>
cc-by 70 creative&attribution creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? <L>
cc-by 70 cc_by&licen cc by(?: [1-4] [05])? <L>
cc-by 60 licen&cc_by <L> cc by(?: [1-4] [05])?
cc-by 50 creativecommons&licenses_by creativecommons org licenses by [1-4] [05]
cc-by-sa 100 identifier&cc_by_sa spdx license identifier cc by sa [1-4] 0
cc-by-sa 90 under&cc_by_sa <V> under <T>(?:a )?(?:creative commons )?cc by sa(?: [1-4] [05])?(?: <L>)?
cc-by-sa 90 under&attribution&share <V> under <T>(?:a )?creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: <L>)?
cc-by-sa 70 attribution&share creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: <L>)?
cc-by-sa 60 licen&cc_by_sa <L> cc by sa(?: [1-4] [05])?
cc-by-sa 50 creativecommons&by_sa creativecommons org licenses by sa [1-4] [05]
cc-by-nc 100 identifier&cc_by_nc spdx license identifier cc by nc [1-4] 0
cc-by-nc 90 under&cc_by_nc <V> under <T>(?:a )?(?:creative commons )?cc by nc(?: [1-4] [05])?(?: <L>)?
cc-by-nc 90 under&attribution&commercial <V> under <T>(?:a )?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: <L>)?
cc-by-nc 70 attribution&commercial creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: <L>)?
cc-by-nc 60 licen&cc_by_nc <L> cc by nc(?: [1-4] [05])?
cc-by-nc 50 creativecommons&by_nc creativecommons org licenses by nc [1-4] [05]
cc-by-nd 100 identifier&cc_by_nd spdx license identifier cc by nd [1-4] 0
cc-by-nd 90 under&cc_by_nd <V> under <T>(?:a )?(?:creative commons )?cc by nd(?: [1-4] [05])?(?: <L>)?
cc-by-nd 70 attribution&deriv creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: <L>)?
cc-by-nd 60 licen&cc_by_nd <L> cc by nd(?: [1-4] [05])?
cc-by-nc-sa 100 identifier&cc_by_nc_sa spdx license identifier cc by nc sa [1-4] 0
cc-by-nc-sa 90 under&cc_by_nc_sa <V> under <T>(?:a )?(?:creative commons )?cc by nc sa(?: [1-4] [05])?(?: <L>)?
cc-by-nc-sa 70 attribution&commercial&share creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: <L>)?
cc-by-nc-sa 60 licen&cc_by_nc_sa <L> cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd 100 identifier&cc_by_nc_nd spdx license identifier cc by nc nd [1-4] 0
cc-by-nc-nd 90 under&cc_by_nc_nd <V> under <T>(?:a )?(?:creative commons )?cc by nc nd(?: [1-4] [05])?(?: <L>)?
cc-by-nc-nd 70 attribution&commercial&deriv creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: <L>)?
cc-by-nc-nd 60 licen&cc_by_nc_nd <L> cc by nc nd(?: [1-4] [05])?
public-domain 90 public&domain (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain 40 public&domain in the public domain
proprietary 90 proprietary&confidential proprietary and confidential
proprietary 70 proprietary&licen proprietary <L> (?:agreement|required|applies)
commercial 70 commercial&licen commercial <L> (?:agreement|required|applies)
proprietary 40 rights&reserved all rights reserved
"""


def rules() -> list[tuple[tuple[str, ...], str, str, int]]:
    """(keywords, pattern, label, priority) of every rule."""
    out = []
    for line in RULES.strip().splitlines():
        label, priority, keywords, pattern = line.split(" ", 3)
        for part, text in PARTS.items():
            pattern = pattern.replace(part, text)
        out.append((tuple(k.replace("_", " ") for k in keywords.split("&")), pattern, label, int(priority)))
    return out
