"""Signature rules of the license scan: `[keyword]` opens the rules that need this word in the text, then one rule a line:
priority (1 before 4), label, expression over lower-cased words joined by one space."""

RULES = r"""
[mit]
1 mit (?:spdx )?license identifier mit
1 mit-0 (?:spdx )?license identifier mit 0
1 mit-0 mit no attribution(?: license)?
2 mit (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit license
2 mit license mit
2 mit (?:is|are) mit licensed
2 mit-x11 mit x11(?: license)?
2 mit-or-apache dual licensed under (?:the )?mit (?:and|or) apache(?: 2 0)?
3 mit (?:the )?mit license(?: mit)?
3 mit under mit
3 mit mit style license
4 mit mit licensed
[expat]
2 mit expat license
2 mit license expat
[permission]
1 mit permission is hereby granted free of charge to any person obtaining a copy of this software
1 isc permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 hpnd permission to use copy modify and distribute this software and its documentation for any purpose
2 ofl permission is hereby granted free of charge to any person obtaining a copy of the font software
3 all-rights-reserved (?:no part of|nothing in) this \w+ may be (?:reproduced|copied) without (?:prior |written |express )*permission
3 permission-notice (?:reprinted|reproduced|used|distributed) (?:with|by) (?:kind )?permission
4 permission-notice without (?:prior |express |written )*permission
[apache]
1 apache-2.0 (?:spdx )?license identifier apache 2 0
1 apache-2.0 licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
2 apache-2.0 licensed under (?:the )?apache license version 2 0
2 apache-2.0 (?:the )?apache (?:software )?license(?: version)? v?2(?: 0)?
2 apache-1.1 (?:the )?apache (?:software )?license(?: version)? v?1 1
2 apache-1.0 (?:the )?apache (?:software )?license(?: version)? v?1 0
2 apache-2.0 apache(?: license)? v2(?: 0)?
2 apache-2.0 license apache 2(?: 0)?
2 apache-2.0 apache org licenses license 2 0
2 apache-llvm apache(?: license)? 2 0 with llvm exceptions?
3 apache (?:released|licensed|distributed|available) under (?:the )?apache(?: license)?
3 apache (?:the )?apache (?:software |public )?license
4 apache apache licensed
[gpl]
1 gpl-3.0+ (?:spdx )?license identifier gpl 3 0 or later
1 gpl-3.0 (?:spdx )?license identifier gpl 3 0(?: only)?
1 gpl-2.0+ (?:spdx )?license identifier gpl 2 0 or later
1 gpl-2.0 (?:spdx )?license identifier gpl 2 0(?: only)?
1 gpl-1.0 (?:spdx )?license identifier gpl 1 0(?: only| or later)?
2 gpl-3.0+ gpl(?: version)? v?3(?: 0)? or (?:any )?later(?: version)?
2 gpl-2.0+ gpl(?: version)? v?2(?: 0)? or (?:any )?later(?: version)?
2 gpl-3.0 gpl(?: version)? v?3(?: 0)?
2 gpl-2.0 gpl(?: version)? v?2(?: 0)?
2 gpl-classpath gpl(?: v?2)? with (?:the )?classpath exception
3 gpl (?:released|licensed|distributed) under (?:the )?(?:gnu )?gpl
3 gpl gnu gpl
4 gpl gpl licensed
[gplv3]
2 gpl-3.0 gplv3
[gplv2]
2 gpl-2.0 gplv2
[lgpl]
1 lgpl-3.0 (?:spdx )?license identifier lgpl 3 0(?: only| or later)?
1 lgpl-2.1 (?:spdx )?license identifier lgpl 2 1(?: only| or later)?
1 lgpl-2.0 (?:spdx )?license identifier lgpl 2 0(?: only| or later)?
2 lgpl-3.0 lgpl(?: version)? v?3(?: 0)?
2 lgpl-2.1 lgpl(?: version)? v?2 1
3 lgpl (?:gnu |under the )lgpl
[lgplv3]
2 lgpl-3.0 lgplv3
[agpl]
1 agpl-3.0 (?:spdx )?license identifier agpl 3 0(?: only| or later)?
2 agpl-3.0 agpl(?: version)? v?3(?: 0)?
3 agpl (?:gnu |under the )agpl
[agplv3]
2 agpl-3.0 agplv3
[affero]
2 agpl-3.0+ gnu affero general public license(?: as published by the free software foundation)? (?:either )?version 3(?: of the license)? or at your option any later version
2 agpl-3.0 (?:gnu )?affero general public license(?: version)? v?3(?: 0)?
3 agpl (?:gnu )?affero (?:general )?public license
[lesser]
2 lgpl-2.1+ gnu lesser general public license(?: as published by the free software foundation)? (?:either )?version 2 1(?: of the license)? or at your option any later version
2 lgpl-3.0 (?:gnu )?lesser general public license(?: version)? v?3(?: 0)?
2 lgpl-2.1 (?:gnu )?lesser general public license(?: version)? v?2 1
3 lgpl (?:gnu )?lesser (?:general )?public license
[library]
2 lgpl-2.0 (?:gnu )?library general public license(?: version)? v?2(?: 0)?
3 lgpl (?:gnu )?library (?:general )?public license
[general]
1 gpl-3.0+ (?:gnu )?general public license as published by the free software foundation (?:either )?version 3 of the license or at your option any later version
1 gpl-2.0+ (?:gnu )?general public license as published by the free software foundation (?:either )?version 2 of the license or at your option any later version
2 gpl-3.0+ (?:gnu )?general public license(?: version)? v?3(?: 0)? or (?:any )?later
2 gpl-2.0+ (?:gnu )?general public license(?: version)? v?2(?: 0)? or (?:any )?later
2 gpl-3.0 licensed under the gnu general public license version 3
2 gpl-2.0 licensed under the gnu general public license version 2
2 gpl-3.0 (?:gnu )?general public license(?: version)? v?3(?: 0)?
2 gpl-2.0 (?:gnu )?general public license(?: version)? v?2(?: 0)?
2 gpl-1.0 (?:gnu )?general public license(?: version)? v?1(?: 0)?
3 gpl (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license
3 gpl (?:gnu )?general public license
[redistribution]
1 bsd-3-clause redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met .{0,900}neither the name
1 bsd-2-clause redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
3 redistribution redistribution(?: and use)? (?:is|are) (?:strictly )?prohibited
[bsd]
1 bsd-3-clause (?:spdx )?license identifier bsd 3 clause
1 bsd-2-clause (?:spdx )?license identifier bsd 2 clause
1 bsd-4-clause (?:spdx )?license identifier bsd 4 clause
2 bsd-4-clause (?:original|4 clause|four clause) bsd(?: license)?
2 bsd-4-clause bsd 4 clause
2 bsd-3-clause (?:new|modified|revised|3 clause|three clause) bsd(?: license)?
2 bsd-3-clause bsd 3(?: clause)?
2 bsd-2-clause (?:simplified|freebsd|2 clause|two clause) (?:bsd )?license
2 bsd-2-clause bsd 2(?: clause)?
2 0bsd zero clause bsd
3 bsd (?:released|licensed|distributed) under (?:the )?(?:a )?bsd(?: style)?(?: license)?
3 bsd (?:the )?bsd(?: style)? license
4 bsd bsd licensed
[0bsd]
1 0bsd (?:spdx )?license identifier 0bsd
2 0bsd 0bsd
[isc]
1 isc (?:spdx )?license identifier isc
2 isc (?:released|licensed) under (?:the )?isc(?: license)?
3 isc (?:the )?isc license
[mozilla]
2 mpl-2.0 mozilla public license(?: version)? v?2(?: 0)?
2 mpl-1.1 mozilla public license(?: version)? v?1 1
2 mpl-1.0 mozilla public license(?: version)? v?1 0
2 mpl-2.0 subject to the terms of the mozilla public license v 2 0
3 mpl (?:the )?mozilla public license
[mpl]
1 mpl-2.0 (?:spdx )?license identifier mpl 2 0
1 mpl-1.1 (?:spdx )?license identifier mpl 1 1
2 mpl-2.0 mpl(?: version)? v?2(?: 0)?
2 mpl-1.1 mpl(?: version)? v?1 1
[eclipse]
2 epl-2.0 eclipse public license(?: version)? v?2(?: 0)?
2 epl-1.0 eclipse public license(?: version)? v?1(?: 0)?
2 edl-1.0 eclipse distribution license(?: version| v)?(?: 1 0)?
3 epl eclipse public license
[epl]
1 epl-2.0 (?:spdx )?license identifier epl 2 0
1 epl-1.0 (?:spdx )?license identifier epl 1 0
2 epl-2.0 epl(?: version)? v?2(?: 0)?
[cddl]
1 cddl-1.0 (?:spdx )?license identifier cddl 1 0
1 cddl-1.1 (?:spdx )?license identifier cddl 1 1
2 cddl-1.1 cddl(?: version)? v?1 1
2 cddl-1.0 cddl(?: version)? v?1(?: 0)?
[distribution]
2 cddl common development and distribution license(?: cddl)?
[common]
2 cpl-1.0 common public license(?: version| v)?(?: 1 0)?
2 cpal-1.0 common public attribution license
[microsoft]
2 ms-pl microsoft public license
2 ms-rl microsoft reciprocal license
3 microsoft-eula microsoft (?:software )?license terms
[artistic]
1 artistic-2.0 (?:spdx )?license identifier artistic 2 0
2 artistic-2.0 (?:the )?artistic license(?: version)? v?2(?: 0)?
2 artistic-1.0 (?:the )?artistic license(?: version)? v?1(?: 0)?
3 artistic (?:perl )?artistic license
[perl]
2 perl same terms as perl(?: itself)?
[boost]
1 bsl-1.0 distributed under the boost software license version 1 0
2 bsl-1.0 boost software license(?: version| v)?(?: 1 0)?
[bsl]
1 bsl-1.0 (?:spdx )?license identifier bsl 1 0
[business]
2 busl-1.1 business source license(?: version| v)?(?: 1 1)?
[zlib]
1 zlib (?:spdx )?license identifier zlib
2 zlib zlib libpng license
3 zlib (?:the )?zlib license
[unlicense]
1 unlicense (?:spdx )?license identifier unlicense
2 unlicense (?:the )?unlicense(?: license)?
[wtfpl]
1 wtfpl (?:spdx )?license identifier wtfpl
3 wtfpl wtfpl(?: license)?
[unencumbered]
1 unlicense this is free and unencumbered software released into the public domain
[domain]
2 public-domain (?:released|dedicated|placed|committed) (?:in|into|to) the public domain
2 public-domain (?:is|are) (?:hereby )?(?:in|into) the public domain
3 public-domain public domain(?: dedication| mark)?
[postgresql]
2 postgresql (?:the )?postgresql license
[python]
2 psf-2.0 python software foundation license(?: version| v)?(?: 2)?
3 psf python license
[psf]
2 psf-2.0 psf license(?: version| v)?(?: 2)?
[ruby]
3 ruby (?:the )?ruby license
[php]
2 php-3.01 php license(?: version)? v?3 01
3 php (?:the )?php license
[openssl]
2 openssl (?:the )?openssl license
[curl]
3 curl (?:the )?curl license
[ncsa]
2 ncsa (?:university of illinois )?ncsa(?: open source)? license
[w3c]
2 w3c w3c software (?:notice and )?(?:document )?license
[vim]
3 vim (?:the )?vim license
[latex]
3 lppl latex project public license
2 lppl latex project public license(?: version| v)?(?: 1 3c?)?
[beerware]
2 beerware (?:the )?beerware license
[beer]
2 beerware the beer ware license
[font]
2 ofl-1.1 sil open font license(?: version| v)?(?: 1 1)?
3 ofl open font license
[ofl]
1 ofl-1.1 (?:spdx )?license identifier ofl 1 1
[upl]
1 upl-1.0 (?:spdx )?license identifier upl 1 0
[universal]
2 upl-1.0 universal permissive license(?: version| v)?(?: 1 0)?
2 cc0-1.0 cc0 1 0 universal
[european]
2 eupl-1.2 european union public licen[cs]e(?: version)? v?1 2
3 eupl european union public licen[cs]e
[eupl]
1 eupl-1.2 (?:spdx )?license identifier eupl 1 2
2 eupl eupl(?: v?1 [012])?
[academic]
2 afl-3.0 academic free license(?: version| v)?(?: 3 0)?
[educational]
2 ecl-2.0 educational community license(?: version| v)?(?: 2 0)?
[osl]
2 osl-3.0 osl 3 0
[open]
2 osl-3.0 open software license(?: version| v)?(?: 3 0)?
2 odbl open (?:data commons open )?database license
2 odc-by open data commons attribution license
2 oga open gaming license
2 ogl open government licen[cs]e(?: v(?:ersion)? ?[123])?
2 rail open rail(?: m)?(?: license)?
[odbl]
2 odbl odbl(?: 1 0)?
[pddl]
2 pddl pddl(?: 1 0)?
[cc0]
1 cc0-1.0 (?:spdx )?license identifier cc0 1 0
2 cc0-1.0 cc0(?: 1 0)?(?: license| waiver| dedication)?
[cc]
1 cc-by-nc-nd (?:spdx )?license identifier cc by nc nd [234] [05]
1 cc-by-nc-sa (?:spdx )?license identifier cc by nc sa [234] [05]
1 cc-by-nc (?:spdx )?license identifier cc by nc [234] [05]
1 cc-by-nd (?:spdx )?license identifier cc by nd [234] [05]
1 cc-by-sa (?:spdx )?license identifier cc by sa [234] [05]
1 cc-by (?:spdx )?license identifier cc by [234] [05]
2 cc-by-nc-nd cc by nc nd(?: [234] [05])?
2 cc-by-nc-sa cc by nc sa(?: [234] [05])?
2 cc-by-nc cc by nc(?: [234] [05])?
2 cc-by-nd cc by nd(?: [234] [05])?
2 cc-by-sa cc by sa(?: [234] [05])?
2 cc-by cc by(?: [234] [05])
[creative]
2 cc-by-nc-nd creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [234] [05])?
2 cc-by-nc-sa creative commons attribution non ?commercial share ?alike(?: [234] [05])?
2 cc-by-nc creative commons attribution non ?commercial(?: [234] [05])?
2 cc-by-nd creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [234] [05])?
2 cc-by-sa creative commons attribution share ?alike(?: [234] [05])?
2 cc-by creative commons attribution(?: [234] [05])?
2 cc0-1.0 creative commons (?:zero|cc0)(?: 1 0)?
3 cc creative commons(?: [a-z]+)? licen[cs]e
4 cc creative commons
[creativecommons]
1 cc0-1.0 creativecommons org publicdomain zero 1 0
1 cc-by-nc-nd creativecommons org licenses by nc nd [1234] [05]
1 cc-by-nc-sa creativecommons org licenses by nc sa [1234] [05]
1 cc-by-nc creativecommons org licenses by nc [1234] [05]
1 cc-by-nd creativecommons org licenses by nd [1234] [05]
1 cc-by-sa creativecommons org licenses by sa [1234] [05]
1 cc-by creativecommons org licenses by [1234] [05]
[documentation]
2 gfdl gnu free documentation license(?: version| v)?(?: 1 [123])?
[gfdl]
2 gfdl gfdl(?: 1 [123])?
[server]
2 sspl-1.0 server side public license(?: version| v)?(?: 1)?
[sspl]
1 sspl-1.0 (?:spdx )?license identifier sspl 1 0
[elastic]
2 elastic-2.0 elastic license(?: version| v)?(?: 2(?: 0)?)?
[clause]
2 commons-clause commons clause(?: license)?(?: condition)?
[polyform]
2 polyform polyform (?:noncommercial|small business|shield|strict) license
[llama]
2 llama llama [23](?: [123])? community license(?: agreement)?
[gemma]
3 gemma gemma terms of use
[rights]
3 all-rights-reserved all rights reserved
4 rights-reserved (?:some|certain) rights reserved
[droits]
3 all-rights-reserved tous droits r.{1,2}serv.{1,2}s
[derechos]
3 all-rights-reserved todos los derechos reservados
[rechte]
3 all-rights-reserved alle rechte vorbehalten
[proprietary]
2 proprietary proprietary and confidential
3 proprietary proprietary license
[confidential]
3 proprietary (?:strictly )?confidential (?:information )?(?:property|and proprietary)
[eula]
3 eula (?:the |this )?eula
[agreement]
2 eula end user license agreement
3 cla contributor license agreement
3 license-agreement software license agreement
[trademark]
4 trademark (?:a )?(?:registered )?trademark of
[trademarks]
4 trademark (?:registered )?trademarks (?:of|are the property of)
[copyright]
3 copyright-notice copyright c? ?(?:19|20)[0-9][0-9]
4 copyright-notice copyright (?:holders?|owners?|notice)
[warranty]
3 no-warranty without warranty of any kind
3 no-warranty (?:comes with )?absolutely no warranty
3 no-warranty provided as is without (?:any )?(?:express or implied )?warranty
[warranties]
3 no-warranty without warranties (?:or conditions )?of any kind
3 no-warranty provided as is without (?:any )?(?:express or implied )?warranties
[licence]
3 licence (?:released|licensed|distributed|published) under (?:the |a )?(?:[a-z0-9]+ ){1,4}licence
[license]
2 license-file see (?:the )?(?:accompanying )?license(?: file| txt| md)? for (?:more )?(?:details|information|terms)
3 license-custom (?:released|licensed|distributed|published) under (?:the |a )?(?:[a-z0-9]+ ){1,4}license
4 license-generic license identifier
[licensed]
4 license-custom (?:this|the) (?:work|software|project|document|file|program|code) is licensed under
[lizenz]
3 license-custom unter (?:der|einer) (?:[a-z0-9]+ ){1,4}lizenz
[licencia]
3 license-custom bajo (?:la|una) licencia(?: [a-z0-9]+)?
"""
