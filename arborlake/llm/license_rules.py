"""The rule table of the license scan: signatures in order of priority, written by hand.

A rule is (label, keyword, pattern). Patterns run over lower-cased text in which each run of white
space and of the marks that separate comment lines is one blank; the keyword must stand in that text
for the pattern to be tried at all. Earlier rules win over later ones of equal extent.
"""

from __future__ import annotations

#: Families with several written forms: label -> patterns of the name itself.
_NAMES: dict[str, list[str]] = {
    "gpl-1.0": [r"gnu general public licen[cs]e,? ver(?:sion|\.) ?1(?:\.0)?\b(?!\.\d)", r"\bgpl ?v?-?1(?:\.0)?\b(?!\.\d)"],
    "gpl-2.0": [r"gnu general public licen[cs]e,? ver(?:sion|\.) ?2(?:\.0)?\b(?!\.\d)", r"\bgpl ?v?-?2(?:\.0)?(?:-only)?\b(?!\.\d|\+|-or)"],
    "gpl-2.0-or-later": [r"gnu general public licen[cs]e[^.]{0,80}ver(?:sion|\.) ?2[^.]{0,60}any later version", r"\bgpl ?v?-?2(?:\.0)?(?:\+|-or-later)"],
    "gpl-3.0": [r"gnu general public licen[cs]e,? ver(?:sion|\.) ?3(?:\.0)?\b(?!\.\d)", r"\bgpl ?v?-?3(?:\.0)?(?:-only)?\b(?!\.\d|\+|-or)"],
    "gpl-3.0-or-later": [r"gnu general public licen[cs]e[^.]{0,80}ver(?:sion|\.) ?3[^.]{0,60}any later version", r"\bgpl ?v?-?3(?:\.0)?(?:\+|-or-later)"],
    "lgpl-2.0": [r"gnu library general public licen[cs]e", r"\blgpl ?v?-?2(?:\.0)?\b(?!\.\d)"],
    "lgpl-2.1": [r"gnu lesser general public licen[cs]e,? ver(?:sion|\.) ?2\.1", r"\blgpl ?v?-?2\.1\b"],
    "lgpl-3.0": [r"gnu lesser general public licen[cs]e,? ver(?:sion|\.) ?3(?:\.0)?\b", r"\blgpl ?v?-?3(?:\.0)?\b(?!\.\d)"],
    "agpl-3.0": [r"gnu affero general public licen[cs]e,? ver(?:sion|\.) ?3(?:\.0)?\b", r"\bagpl ?v?-?3(?:\.0)?\b"],
    "agpl": [r"gnu affero general public licen[cs]e", r"\bagpl\b"],
    "lgpl": [r"gnu lesser general public licen[cs]e", r"\blgpl\b"],
    "fdl": [r"gnu free documentation licen[cs]e", r"\bgfdl\b"],
    "apache-1.0": [r"apache licen[cs]e,? ver(?:sion|\.) ?1\.0", r"\bapache-1\.0\b"],
    "apache-1.1": [r"apache (?:software )?licen[cs]e,? ver(?:sion|\.) ?1\.1", r"\bapache-1\.1\b"],
    "apache-2.0": [r"apache licen[cs]e,? (?:ver(?:sion|\.) ?|v)?2(?:\.0)?\b", r"\bapache-2\.0\b", r"apache\.org/licenses/license-2\.0"],
    "bsd-2-clause": [r"(?:simplified|freebsd|2-clause|two-clause) bsd licen[cs]e", r"bsd 2-clause", r"\bbsd-2-clause\b"],
    "bsd-3-clause": [r"(?:new|revised|modified|3-clause|three-clause) bsd licen[cs]e", r"bsd 3-clause", r"\bbsd-3-clause\b"],
    "bsd-4-clause": [r"(?:original|4-clause|four-clause) bsd licen[cs]e", r"bsd 4-clause", r"\bbsd-4-clause\b"],
    "bsd-0-clause": [r"zero-clause bsd", r"\b0bsd\b"],
    "bsd": [r"\bbsd licen[cs]e\b", r"\bbsd-style licen[cs]e\b"],
    "mit-0": [r"mit no attribution", r"\bmit-0\b"],
    "x11": [r"\bx11 licen[cs]e\b"],
    "isc": [r"\bisc licen[cs]e\b", r"internet systems consortium licen[cs]e"],
    "mpl-1.0": [r"mozilla public licen[cs]e,? ver(?:sion|\.) ?1\.0", r"\bmpl[- ]?1\.0\b"],
    "mpl-1.1": [r"mozilla public licen[cs]e,? ver(?:sion|\.) ?1\.1", r"\bmpl[- ]?1\.1\b"],
    "mpl-2.0": [r"mozilla public licen[cs]e,? (?:ver(?:sion|\.) ?|v\. ?)2\.0", r"\bmpl[- ]?2\.0\b", r"mozilla\.org/mpl/2\.0"],
    "epl-1.0": [r"eclipse public licen[cs]e,? (?:ver(?:sion|\.) ?|- ?v ?)1\.0", r"\bepl[- ]?1\.0\b"],
    "epl-2.0": [r"eclipse public licen[cs]e,? (?:ver(?:sion|\.) ?|- ?v ?)2\.0", r"\bepl[- ]?2\.0\b"],
    "cddl-1.0": [r"common development and distribution licen[cs]e,? (?:ver(?:sion|\.) ?)?1\.0", r"\bcddl[- ]?1\.0\b"],
    "cddl-1.1": [r"common development and distribution licen[cs]e,? (?:ver(?:sion|\.) ?)?1\.1", r"\bcddl[- ]?1\.1\b"],
    "cpl-1.0": [r"common public licen[cs]e,? (?:ver(?:sion|\.) ?)?1\.0", r"\bcpl[- ]1\.0\b"],
    "artistic-1.0": [r"artistic licen[cs]e,? (?:ver(?:sion|\.) ?)?1\.0", r"\bartistic-1\.0\b"],
    "artistic-2.0": [r"artistic licen[cs]e,? (?:ver(?:sion|\.) ?)?2\.0", r"\bartistic-2\.0\b"],
    "zlib": [r"\bzlib licen[cs]e\b", r"zlib/libpng licen[cs]e"],
    "boost-1.0": [r"boost software licen[cs]e", r"\bbsl-1\.0\b"],
    "unlicense": [r"this is free and unencumbered software released into the public domain", r"\bthe unlicense\b", r"unlicense\.org"],
    "wtfpl": [r"do what the fuck you want to public licen[cs]e", r"\bwtfpl\b"],
    "psf-2.0": [r"python software foundation licen[cs]e", r"\bpsf-2\.0\b"],
    "python-2.0": [r"\bpython licen[cs]e 2\.0\b", r"\bpython-2\.0 licen[cs]e\b"],
    "ofl-1.1": [r"sil open font licen[cs]e", r"\bofl-1\.1\b"],
    "openssl": [r"\bopenssl licen[cs]e\b"],
    "postgresql": [r"\bpostgresql licen[cs]e\b"],
    "php-3.01": [r"\bphp licen[cs]e,? (?:ver(?:sion|\.) ?)?3\.01\b"],
    "php": [r"\bphp licen[cs]e\b"],
    "ruby": [r"\bruby licen[cs]e\b", r"\bruby's licen[cs]e\b"],
    "ncsa": [r"university of illinois/ncsa open source licen[cs]e", r"\bncsa licen[cs]e\b"],
    "ms-pl": [r"microsoft public licen[cs]e", r"\bms-pl\b"],
    "ms-rl": [r"microsoft reciprocal licen[cs]e", r"\bms-rl\b"],
    "eupl-1.1": [r"european union public licen[cs]e,? (?:ver(?:sion|\.) ?|v\. ?)?1\.1", r"\beupl[- ]1\.1\b"],
    "eupl-1.2": [r"european union public licen[cs]e,? (?:ver(?:sion|\.) ?|v\. ?)?1\.2", r"\beupl[- ]1\.2\b"],
    "cecill": [r"\bcecill\b"],
    "qpl": [r"\bq public licen[cs]e\b"],
    "afl-3.0": [r"academic free licen[cs]e,? (?:ver(?:sion|\.) ?|v\. ?)?3\.0", r"\bafl-3\.0\b"],
    "osl-3.0": [r"open software licen[cs]e,? (?:ver(?:sion|\.) ?|v\. ?)?3\.0", r"\bosl-3\.0\b"],
    "upl": [r"universal permissive licen[cs]e"],
    "vim": [r"\bvim licen[cs]e\b"],
    "tcl": [r"\btcl/tk licen[cs]e\b"],
    "w3c": [r"\bw3c software (?:notice and )?licen[cs]e\b"],
    "ijg": [r"independent jpeg group licen[cs]e"],
    "curl": [r"\bcurl licen[cs]e\b"],
    "beerware": [r"\bbeer-?ware licen[cs]e\b"],
    "cc0-1.0": [r"\bcc0(?:[ -]1\.0)?\b", r"creative commons zero", r"publicdomain/zero/1\.0"],
    "odbl-1.0": [r"open data(?:base)? (?:commons open database )?licen[cs]e", r"\bodbl\b"],
    "odc-by": [r"open data commons attribution licen[cs]e", r"\bodc-by\b"],
    "pddl": [r"public domain dedication and licen[cs]e", r"\bpddl\b"],
    "cdla-permissive": [r"community data licen[cs]e agreement[ -–]{1,4}permissive", r"\bcdla-permissive\b"],
    "cdla-sharing": [r"community data licen[cs]e agreement[ -–]{1,4}sharing", r"\bcdla-sharing\b"],
    "openrail": [r"\bopenrail(?:-m)?\b", r"responsible ai licen[cs]e"],
    "busl-1.1": [r"business source licen[cs]e 1\.1", r"\bbusl-1\.1\b"],
    "sspl-1.0": [r"server side public licen[cs]e", r"\bsspl\b"],
    "elastic-2.0": [r"\belastic licen[cs]e (?:ver(?:sion|\.) ?|v)?2(?:\.0)?\b"],
    "commons-clause": [r"\bcommons clause\b"],
    "gpl-linking": [r"gpl(?:v[23])? with (?:the )?classpath exception", r"\bclasspath exception\b", r"gcc runtime library exception", r"autoconf (?:configure )?exception", r"bison (?:parser )?exception", r"linking exception to the gpl"],
    "gpl-any": [r"\bgnu gpl\b", r"gnu general public licen[cs]e", r"\bgpl-compatible\b", r"released under (?:the )?gpl\b", r"gnu\.org/licenses/(?:old-licenses/)?gpl"],
    "lgpl-2.1-or-later": [r"gnu lesser general public licen[cs]e[^.]{0,80}ver(?:sion|\.) ?2\.1[^.]{0,60}any later version", r"\blgpl ?v?-?2\.1(?:\+|-or-later)"],
    "lgpl-3.0-or-later": [r"gnu lesser general public licen[cs]e[^.]{0,80}ver(?:sion|\.) ?3[^.]{0,60}any later version", r"\blgpl ?v?-?3(?:\.0)?(?:\+|-or-later)", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"],
    "agpl-3.0-or-later": [r"gnu affero general public licen[cs]e[^.]{0,80}ver(?:sion|\.) ?3[^.]{0,60}any later version", r"\bagpl ?v?-?3(?:\.0)?(?:\+|-or-later)", r"gnu\.org/licenses/agpl"],
    "agpl-1.0": [r"affero general public licen[cs]e,? ver(?:sion|\.) ?1\b", r"\bagpl ?v?-?1(?:\.0)?\b"],
    "fdl-1.2": [r"gnu free documentation licen[cs]e,? ver(?:sion|\.) ?1\.2", r"\bgfdl[- ]?1\.2\b"],
    "fdl-1.3": [r"gnu free documentation licen[cs]e,? ver(?:sion|\.) ?1\.3", r"\bgfdl[- ]?1\.3\b", r"gnu\.org/licenses/fdl"],
    "apache": [r"\bapache software licen[cs]e\b", r"\bapache-style licen[cs]e\b", r"licen[cs]ed to the apache software foundation", r"\basl ?2\.0\b"],
    "bsd-1-clause": [r"(?:1-clause|one-clause) bsd", r"\bbsd-1-clause\b"],
    "bsd-2-clause-patent": [r"bsd[ -]2-clause (?:plus )?patent", r"\bbsd\+patent\b"],
    "bsd-3-clause-clear": [r"clear bsd licen[cs]e", r"\bbsd-3-clause-clear\b"],
    "bsd-protection": [r"bsd protection licen[cs]e"],
    "bsd-source-code": [r"bsd source code attribution"],
    "mit-advertising": [r"enlightenment licen[cs]e", r"mit licen[cs]e with advertising", r"\bmit-advertising\b"],
    "mit-cmu": [r"cmu licen[cs]e", r"\bmit-cmu\b", r"carnegie mellon university licen[cs]e"],
    "mit-feh": [r"\bfeh licen[cs]e\b"],
    "mit-named": [r"\bexpat licen[cs]e\b", r"\bmit/x11\b", r"\bmit-style licen[cs]e\b", r"opensource\.org/licenses/mit\b", r"mit-license\.org", r"\bmit open source licen[cs]e\b"],
    "bsd-named": [r"opensource\.org/licenses/bsd-[23]-clause", r"berkeley software distribution licen[cs]e"],
    "mpl-2.0-no-copyleft": [r"incompatible with secondary licen[cs]es", r"mpl-2\.0-no-copyleft-exception"],
    "mpl": [r"\bmozilla public licen[cs]e\b", r"\bmpl licen[cs]e\b", r"mozilla\.org/mpl"],
    "npl-1.1": [r"netscape public licen[cs]e", r"\bnpl-1\.1\b"],
    "epl": [r"\beclipse public licen[cs]e\b", r"eclipse\.org/legal/epl", r"eclipse distribution licen[cs]e"],
    "cddl": [r"common development and distribution licen[cs]e", r"\bcddl\b"],
    "cpl": [r"\bcommon public licen[cs]e\b"],
    "ibm-pl": [r"ibm public licen[cs]e"],
    "lucent-pl": [r"lucent public licen[cs]e", r"\blpl-1\.02\b"],
    "intel": [r"intel open source licen[cs]e", r"intel simplified software licen[cs]e"],
    "nokia": [r"nokia open source licen[cs]e"],
    "sun-sissl": [r"sun industry standards source licen[cs]e", r"\bsissl\b"],
    "spl-1.0": [r"sun public licen[cs]e"],
    "rpl-1.5": [r"reciprocal public licen[cs]e"],
    "rpsl": [r"realnetworks public source licen[cs]e"],
    "apsl-2.0": [r"apple public source licen[cs]e", r"\bapsl-?[12]\.\d\b"],
    "artistic": [r"\bartistic licen[cs]e\b", r"same terms as perl(?: itself)?", r"\bclarified artistic licen[cs]e\b"],
    "perl": [r"\bperl_5 licen[cs]e\b", r"the perl 5 licen[cs]e"],
    "zlib-libpng": [r"\blibpng licen[cs]e\b", r"\bpng reference library licen[cs]e\b"],
    "bzip2": [r"\bbzip2 licen[cs]e\b"],
    "info-zip": [r"\binfo-zip licen[cs]e\b"],
    "libtiff": [r"\blibtiff licen[cs]e\b"],
    "freetype": [r"freetype project licen[cs]e", r"\bftl licen[cs]e\b", r"the freetype licen[cs]e"],
    "imagemagick": [r"\bimagemagick licen[cs]e\b"],
    "openldap": [r"openldap public licen[cs]e", r"\boldap-2\.8\b"],
    "openssl-named": [r"openssl toolkit \(http", r"\bssleay licen[cs]e\b", r"this product includes cryptographic software written by eric young"],
    "ntp": [r"\bntp licen[cs]e\b"],
    "hpnd": [r"historical permission notice and disclaimer", r"\bhpnd\b"],
    "icu": [r"\bicu licen[cs]e\b"],
    "unicode": [r"unicode licen[cs]e(?: agreement)?", r"\bunicode-dfs-201[56]\b", r"unicode data files and software licen[cs]e"],
    "w3c-documents": [r"w3c document licen[cs]e", r"w3c test suite licen[cs]e", r"w3c community contributor licen[cs]e"],
    "ogc": [r"\bogc software licen[cs]e\b"],
    "ofl-1.0": [r"open font licen[cs]e,? (?:ver(?:sion|\.) ?)?1\.0", r"\bofl-1\.0\b", r"scripts\.sil\.org/ofl"],
    "ubuntu-font": [r"ubuntu font licen[cs]e"],
    "bitstream-vera": [r"bitstream vera (?:fonts? )?(?:copyright|licen[cs]e)"],
    "lppl-1.3c": [r"latex project public licen[cs]e", r"\blppl(?:[- ]1\.3[ac]?)?\b"],
    "knuth": [r"knuth licen[cs]e", r"\bctan licen[cs]e\b"],
    "cecill-b": [r"\bcecill-b\b", r"licence cecill-b"],
    "cecill-c": [r"\bcecill-c\b", r"licence cecill-c"],
    "cecill-2.1": [r"\bcecill[- ](?:v ?)?2(?:\.[01])?\b", r"licence libre cecill"],
    "licence-ouverte": [r"licence ouverte", r"\betalab-2\.0\b", r"licence ouverte etalab"],
    "dl-de": [r"datenlizenz deutschland", r"\bdl-de/by-2-0\b", r"\bdl-de/zero-2-0\b"],
    "dfsl": [r"deutsche freie software lizenz", r"\bd-fsl-1\.0\b"],
    "eupl": [r"european union public licen[cs]e", r"licence publique de l'union europ[eé]enne", r"licencia p[uú]blica de la uni[oó]n europea", r"\beupl\b"],
    "ogl-uk": [r"open government licen[cs]e(?: v(?:ersion )?\d(?:\.0)?)?", r"\bogl-uk-[123]\.0\b", r"nationalarchives\.gov\.uk/doc/open-government-licence"],
    "ogl-canada": [r"open government licen[cs]e - canada"],
    "nasa-1.3": [r"nasa open source agreement"],
    "mulan-psl-2.0": [r"mulan permissive software licen[cs]e", r"\bmulanpsl[- ]2\.0\b"],
    "oset-pl": [r"oset public licen[cs]e"],
    "cal-1.0": [r"cryptographic autonomy licen[cs]e"],
    "parity": [r"\bparity public licen[cs]e\b"],
    "polyform-nc": [r"polyform noncommercial licen[cs]e", r"polyform non-commercial licen[cs]e"],
    "polyform-sb": [r"polyform small business licen[cs]e"],
    "polyform-shield": [r"polyform (?:shield|perimeter|strict) licen[cs]e"],
    "prosperity": [r"prosperity public licen[cs]e"],
    "hippocratic": [r"hippocratic licen[cs]e"],
    "anti-996": [r"anti[- ]996 licen[cs]e"],
    "blueoak": [r"blue oak model licen[cs]e", r"\bblueoak-1\.0\.0\b"],
    "fair": [r"\bfair licen[cs]e\b", r"usage of the works is permitted provided that this instrument is retained"],
    "afl": [r"\bacademic free licen[cs]e\b", r"\bafl ?v?[12]\.\d\b"],
    "osl": [r"\bopen software licen[cs]e\b", r"\bosl[- ]?[12]\.\d\b"],
    "ecl-2.0": [r"educational community licen[cs]e", r"\becl-2\.0\b"],
    "efl-2.0": [r"eiffel forum licen[cs]e"],
    "entessa": [r"entessa public licen[cs]e"],
    "frameworx": [r"frameworx open licen[cs]e"],
    "catosl": [r"computer associates trusted open source licen[cs]e"],
    "cua-opl": [r"cua office public licen[cs]e"],
    "eudatagrid": [r"eu datagrid software licen[cs]e"],
    "motosoto": [r"motosoto open source licen[cs]e"],
    "multics": [r"\bmultics licen[cs]e\b"],
    "naumen": [r"naumen public licen[cs]e"],
    "ngpl": [r"nethack general public licen[cs]e"],
    "oclc": [r"oclc research public licen[cs]e"],
    "pddl-named": [r"opendatacommons\.org/licenses/pddl", r"open data commons public domain dedication"],
    "odbl-named": [r"opendatacommons\.org/licenses/odbl", r"open database licen[cs]e \(odbl\)"],
    "odc-by-named": [r"opendatacommons\.org/licenses/by"],
    "cc0": [r"\bcc zero\b", r"no rights reserved", r"creative commons public domain dedication", r"\bcc-zero\b"],
    "cc-pdm": [r"public domain mark 1\.0", r"publicdomain/mark/1\.0", r"\bcc-pdm\b"],
    "cc-sampling": [r"creative commons sampling(?: plus)?", r"creativecommons\.org/licenses/sampling"],
    "cc-by-named": [r"creative commons attribution (?:licen[cs]e|\d\.\d)", r"licencia creative commons(?: de)? (?:atribuci[oó]n|reconocimiento)", r"creative commons namensnennung", r"licence creative commons (?:paternit[eé]|attribution)"],
    "cc-by-sa-named": [r"creative commons attribution[ -]share ?alike", r"creative commons namensnennung[ -]+weitergabe unter gleichen bedingungen", r"creative commons attribution[ -]+partage dans les m[eê]mes conditions", r"creative commons (?:atribuci[oó]n|reconocimiento)[ -]+compartir ?igual"],
    "cc-by-nc-named": [r"creative commons attribution[ -]non ?commercial", r"creative commons namensnennung[ -]+nicht[ -]?kommerziell", r"creative commons attribution[ -]+pas d'utilisation commerciale", r"creative commons (?:atribuci[oó]n|reconocimiento)[ -]+no ?comercial"],
    "cc-by-nd-named": [r"creative commons attribution[ -]no ?deriv", r"creative commons namensnennung[ -]+keine bearbeitung"],
    "cc": [r"\bcreative commons licen[cs]e\b", r"some rights reserved"],
    "gfdl-or-cc": [r"dual[- ]licen[cs]ed under (?:the )?gfdl and"],
    "free-art": [r"free art licen[cs]e", r"licence art libre", r"artlibre\.org"],
    "opl-1.0": [r"open publication licen[cs]e", r"opencontent\.org/openpub"],
    "open-content": [r"opencontent licen[cs]e", r"open content licen[cs]e"],
    "against-drm": [r"against drm licen[cs]e"],
    "design-science": [r"design science licen[cs]e"],
    "ethymonics": [r"ethymonics free music licen[cs]e"],
    "linux-docs": [r"linux documentation project (?:copying )?licen[cs]e", r"\bldpl\b"],
    "freebsd-docs": [r"freebsd documentation licen[cs]e"],
    "llama": [r"llama \d(?:\.\d)? community licen[cs]e", r"meta llama licen[cs]e"],
    "gemma": [r"gemma terms of use"],
    "bigscience-rail": [r"bigscience (?:bloom )?rail licen[cs]e", r"\bbigscience-openrail-m\b"],
    "creativeml-openrail": [r"creativeml open ?rail(?:[ -]m)?"],
    "bigcode-openrail": [r"bigcode open ?rail(?:[ -]m)?"],
    "nvidia-open-model": [r"nvidia open model licen[cs]e"],
    "sspl-named": [r"mongodb server side public licen[cs]e"],
    "confluent": [r"confluent community licen[cs]e"],
    "timescale": [r"timescale licen[cs]e(?: agreement)?"],
    "redis": [r"redis source available licen[cs]e", r"\brsalv2\b"],
    "fsl-1.1": [r"functional source licen[cs]e", r"\bfsl-1\.1-(?:mit|apache-2\.0|alv2)\b"],
    "bsl-mariadb": [r"mariadb business source licen[cs]e", r"\bbusiness source licen[cs]e\b"],
    "oracle-bcl": [r"oracle binary code licen[cs]e", r"\boracle no-fee terms\b"],
    "oracle-otn": [r"oracle technology network licen[cs]e"],
    "sun-bcl": [r"sun microsystems,? inc\.? binary code licen[cs]e"],
    "ms-eula": [r"microsoft software licen[cs]e terms", r"end[- ]user licen[cs]e agreement", r"\beula\b"],
    "ms-lpl": [r"microsoft limited public licen[cs]e", r"\bms-lpl\b"],
    "ms-shared-source": [r"microsoft shared source"],
    "adobe-2006": [r"adobe systems incorporated source code licen[cs]e", r"adobe glyph list licen[cs]e"],
    "json": [r"the software shall be used for good,? not evil", r"\bjson licen[cs]e\b"],
    "wxwindows": [r"wxwindows library licen[cs]e", r"wxwidgets licen[cs]e"],
    "zpl-2.1": [r"zope public licen[cs]e", r"\bzpl[- ]?2\.[01]\b"],
    "vovida": [r"vovida software licen[cs]e"],
    "watcom": [r"sybase open watcom public licen[cs]e"],
    "xnet": [r"\bx\.net licen[cs]e\b"],
    "simple-pl": [r"simple public licen[cs]e"],
    "sleepycat": [r"sleepycat licen[cs]e", r"berkeley db (?:java edition )?licen[cs]e"],
    "ssh": [r"\bopenssh licen[cs]e\b"],
    "tmate": [r"\btmate (?:open source )?licen[cs]e\b"],
    "torque": [r"torque (?:v2\.5\+ )?software licen[cs]e"],
    "spencer": [r"henry spencer licen[cs]e", r"spencer licen[cs]e"],
    "tcp-wrappers": [r"tcp wrappers licen[cs]e"],
    "bittorrent": [r"bittorrent open source licen[cs]e"],
    "borceux": [r"borceux licen[cs]e"],
    "caldera": [r"\bcaldera licen[cs]e\b"],
    "crossword": [r"crossword licen[cs]e"],
    "dotseqn": [r"dotseqn licen[cs]e"],
    "glulxe": [r"glulxe licen[cs]e"],
    "gnuplot": [r"\bgnuplot licen[cs]e\b"],
    "gsoap": [r"gsoap public licen[cs]e"],
    "haskell-report": [r"haskell language report licen[cs]e"],
    "interbase": [r"interbase public licen[cs]e"],
    "jasper": [r"\bjasper(?:-2\.0)? licen[cs]e\b"],
    "leptonica": [r"\bleptonica licen[cs]e\b"],
    "mup": [r"\bmup licen[cs]e\b"],
    "net-snmp": [r"\bnet-snmp licen[cs]e\b"],
    "nlpl": [r"no limit public licen[cs]e"],
    "plexus": [r"plexus classworlds licen[cs]e"],
    "psutils": [r"\bpsutils licen[cs]e\b"],
    "qhull": [r"\bqhull (?:copyright|licen[cs]e)\b"],
    "sax-pd": [r"sax public domain notice"],
    "scea": [r"scea shared source licen[cs]e"],
    "smlnj": [r"standard ml of new jersey licen[cs]e"],
    "sugarcrm": [r"sugarcrm public licen[cs]e"],
    "yahoo-pl": [r"yahoo! public licen[cs]e"],
    "zend": [r"\bzend (?:engine )?licen[cs]e\b"],
    "zimbra": [r"zimbra public licen[cs]e"],
    "freeware": [r"\bthis (?:software|program) is freeware\b", r"\bdistributed as freeware\b"],
    "shareware": [r"\bthis (?:software|program) is shareware\b"],
    "noncommercial": [r"for non-?commercial (?:use|purposes) only", r"personal,? non-?commercial use only", r"nur f[uü]r nicht-?kommerzielle zwecke", r"uso exclusivamente no comercial"],
    "research-only": [r"for (?:academic|research) (?:use|purposes) only", r"academic free use only"],
    "no-derivatives": [r"no derivative works (?:are )?(?:permitted|allowed)"],
    "reproduction-forbidden": [r"reproduction (?:in whole or in part )?(?:is )?(?:strictly )?(?:prohibited|forbidden)", r"tous droits r[eé]serv[eé]s", r"todos los derechos reservados", r"alle rechte vorbehalten"],
    "dual-license": [r"dual[- ]licen[cs]ed", r"available under (?:either of )?two licen[cs]es"],
    "public-domain": [r"(?:placed|released|dedicated) (?:in|in ?to) the public domain", r"\bpublic domain work\b"],
    "proprietary": [r"\ball rights reserved\b", r"proprietary and confidential", r"unauthori[sz]ed copying of this (?:file|document)"],
}

#: Sentences that state a grant, by what follows from their words alone.
_GRANTS: list[tuple[str, str]] = [
    ("mit", r"to deal in the software without restriction, including without limitation the rights to use, copy, modify"),
    ("apache-2.0", r"distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing, software"),
    ("apache-2.0", r"licen[cs]ed to the apache software foundation \(asf\) under one or more contributor licen[cs]e agreements"),
    ("bsd-2-clause", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-2-clause", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", r"this software is provided by the copyright holders and contributors \"as is\""),
    ("bsd", r"this software is provided by the regents and contributors"),
    ("isc", r"the author disclaims all warranties with regard to this software"),
    ("zlib", r"altered source versions must be plainly marked as such"),
    ("zlib", r"the origin of this software must not be misrepresented"),
    ("boost-1.0", r"machine-executable object code generated by a source language processor"),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0-1.0", r"to the extent possible under law, .{1,80}? has waived all copyright"),
    ("gpl", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", r"you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("agpl", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("fdl", r"with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts"),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[cs]e"),
    ("ofl-1.1", r"this font software is licen[cs]ed under the sil open font licen[cs]e"),
    ("artistic", r"you can redistribute it and/or modify it under the same terms as perl itself"),
    ("beerware", r"you can buy me a beer in return"),
    ("wtfpl", r"0\. you just do what the fuck you want to"),
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", r"shall be included in all copies or substantial portions of the software"),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", r"redistribution and use in source and binary forms,? with or without modification"),
    ("bsd-3-clause", r"neither the names? of .{1,80}? may be used to endorse or promote products"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software"),
    ("apache-2.0", r"you may not use this file except in compliance with the licen[cs]e"),
    ("gpl", r"redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", r"redistribute it and/or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("boost-1.0", r"distributed under the boost software licen[cs]e"),
    ("zlib", r"this software is provided 'as-is', without any express or implied warranty"),
    ("cc-by", r"licen[cs]ed under (?:a|the) creative commons attribution (?:\d\.\d )?(?:international |unported |generic )?licen[cs]e"),
    ("cc-by-sa", r"licen[cs]ed under (?:a|the) creative commons attribution[ -]share ?alike"),
    ("cc-by-nc", r"licen[cs]ed under (?:a|the) creative commons attribution[ -]non ?commercial"),
    ("cc-by-nd", r"licen[cs]ed under (?:a|the) creative commons attribution[ -]no ?deriv"),
]

#: Creative Commons by elements and version, each in its short form and as its address.
_CC_ELEMENTS = ["by-nc-nd", "by-nc-sa", "by-nc", "by-nd", "by-sa", "by"]
_CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]


def _keyword(pattern: str) -> str:
    """The longest run of plain letters that every match must hold."""
    import re

    plain = re.sub(r"\(\?[:!=][^()]*\)\??|\[[^\]]*\]\??|\\.\??|.\?|\{[^}]*\}", "\x00", pattern)
    return max(re.findall(r"[a-z0-9 /'-]+", plain), key=len, default="")


def rules() -> list[tuple[str, str, str]]:
    """All rules, first the most specific: (label, keyword, pattern)."""
    out = [(label, _keyword(p), p) for label, p in _GRANTS]
    for elements in _CC_ELEMENTS:
        spaced = elements.replace("-", "[ -]")
        for version in _CC_VERSIONS:
            v = version.replace(".", r"\.")
            out.append((f"cc-{elements}-{version}", "cc", rf"\bcc[ -]{spaced}[ -]{v}\b"))
            out.append((f"cc-{elements}-{version}", "creativecommons", rf"creativecommons\.org/licenses/{elements}/{v}"))
        if elements != "by":
            out.append((f"cc-{elements}", "cc", rf"\bcc[ -]{spaced}\b"))
    for name, patterns in _NAMES.items():
        label = name.removesuffix("-named").removesuffix("-any")  # further forms of another entry's name
        out += [(label, _keyword(p), p) for p in patterns]
    # SPDX tags: the label as it is written, for every label above.
    for label in dict.fromkeys(label for label, _, _ in list(out)):
        escaped = label.replace(".", r"\.")
        out.append((label, "spdx-license-identifier", rf"spdx-licen[cs]e-identifier: ?\(?{escaped}(?![\w.-])"))
    return out
