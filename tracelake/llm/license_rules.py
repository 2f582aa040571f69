"""The signature rules of the license scan: (label, priority, keyword, pattern).

A keyword's words, each by itself, are plain text in every match of its pattern; patterns run over text with A-Z lowered.
``_`` in a pattern stands for a gap between words, of any length: white space, punctuation or comment marks; ``_?`` may be none. No
pattern has two gaps in a row, so a long one is passed once for each rule.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern


GAP = r"[\s\"'(),./*#;:-]+"
VERSION = r"_?(?:(?:v|version|ver)_?)?"

#: Hand-written signatures. Priority 90: names a version; 80: a whole sentence of the license; 70: a plain name; 50: a hint.
SIGNATURES = [
    ("apache-2.0", 90, "apache", r"apache_(?:software_)?licen[sc]e_(?:version_)?2(?:\.0)?\b"),
    ("apache-1.1", 90, "apache", r"apache_(?:software_)?licen[sc]e_(?:version_)?1\.1\b"),
    ("apache-1.0", 90, "apache", r"apache_(?:software_)?licen[sc]e_(?:version_)?1\.0\b"),
    ("apache-2.0", 80, "apache.org/licenses", r"apache\.org/licenses/license-2\.0"),
    ("apache-2.0", 80, "unless applicable", r"unless_required_by_applicable_law_or_agreed_to_in_writing"),
    ("apache", 70, "apache", r"\bapache_(?:software_)?licen[sc]ed?\b"),
    ("apache-2.0", 90, "asl", r"\basl_2\.0\b"),
    ("mit", 90, "mit", r"\bmit_licen[sc]ed?\b"),
    ("mit", 80, "permission hereby granted", r"permission_is_hereby_granted_free_of_charge_to_any_person_obtaining_a_copy"),
    ("mit", 90, "x11", r"\bmit/x11\b"),
    ("x11", 70, "x11", r"\bx11_licen[sc]e\b"),
    ("expat", 70, "expat", r"\bexpat_licen[sc]e\b"),
    ("mit-0", 95, "mit", r"\bmit_no_attribution\b"),
    ("bsd-2-clause", 90, "bsd", r"\b(?:2|two)_clause_bsd\b|\bbsd_(?:2|two)_clause\b|\bsimplified_bsd_licen[sc]e\b"),
    ("bsd-3-clause", 90, "bsd", r"\b(?:3|three)_clause_bsd\b|\bbsd_(?:3|three)_clause\b|\b(?:new|revised|modified)_bsd_licen[sc]e\b"),
    ("bsd-4-clause", 90, "bsd", r"\b(?:4|four)_clause_bsd\b|\bbsd_(?:4|four)_clause\b|\boriginal_bsd_licen[sc]e\b"),
    ("0bsd", 90, "bsd", r"\b(?:zero_clause|0_clause)_bsd\b|\bbsd_(?:zero|0)_clause\b"),
    ("bsd", 70, "bsd", r"\bbsd_(?:style_)?licen[sc]ed?\b"),
    ("bsd", 80, "redistribution", r"redistribution_and_use_in_source_and_binary_forms"),
    ("bsd-3-clause", 80, "endorse promote", r"endorse_or_promote_products_derived_from_this_software"),
    ("isc", 90, "isc", r"\bisc_licen[sc]e\b"),
    ("isc", 80, "permission modify distribute", r"permission_to_use_copy_modify_and(?:_or)?_distribute_this_software_for_any_purpose"),
    ("ncsa", 70, "ncsa", r"\b(?:university_of_illinois_)?ncsa_(?:open_source_)?licen[sc]e\b"),
    ("zlib", 70, "zlib", r"\bzlib(?:_libpng)?_licen[sc]e\b"),
    ("zlib", 80, "provided express warranty", r"this_software_is_provided_as_is_without_any_express_or_implied_warranty"),
    ("libpng", 70, "libpng", r"\blibpng_licen[sc]e\b"),
    ("bsl-1.0", 90, "boost", r"\bboost_software_licen[sc]e(?:_version_1\.0)?\b"),
    ("unlicense", 80, "unencumbered", r"free_and_unencumbered_software_released_into_the_public_domain"),
    ("unlicense", 70, "unlicense", r"\bthe_unlicense\b|\bunlicense\.org\b"),
    ("wtfpl", 70, "wtfpl", r"\bwtfpl\b"),
    ("wtfpl", 80, "fuck", r"do_what_the_fuck_you_want_to_public_licen[sc]e"),
    ("public-domain", 70, "public domain", r"\b(?:in|into|to)_the_public_domain\b"),
    ("public-domain", 60, "public domain", r"\bpublic_domain_(?:work|dedication|notice)\b"),
    ("artistic-2.0", 90, "artistic", r"\bartistic_licen[sc]e_(?:version_)?2(?:\.0)?\b"),
    ("artistic-1.0", 90, "artistic", r"\bartistic_licen[sc]e_(?:version_)?1(?:\.0)?\b"),
    ("artistic", 70, "artistic", r"\bartistic_licen[sc]e\b"),
    ("perl", 70, "perl", r"\bsame_terms_as_perl\b"),
    ("python-2.0", 70, "python", r"\bpython_(?:software_foundation_)?licen[sc]e\b"),
    ("python-2.0", 70, "psf", r"\bpsf_licen[sc]e\b"),
    ("ruby", 70, "ruby", r"\bruby_licen[sc]e\b"),
    ("php-3.01", 90, "php", r"\bphp_licen[sc]e_(?:version_)?3\.01\b"),
    ("php-3.0", 90, "php", r"\bphp_licen[sc]e_(?:version_)?3\.0\b"),
    ("php", 70, "php", r"\bphp_licen[sc]e\b"),
    ("zpl-2.1", 90, "zope", r"\bzope_public_licen[sc]e_(?:version_)?2\.1\b"),
    ("zpl", 70, "zope", r"\bzope_public_licen[sc]e\b"),
    ("openssl", 70, "openssl", r"\bopenssl_licen[sc]e\b"),
    ("ssleay", 70, "ssleay", r"\bssleay_licen[sc]e\b"),
    ("postgresql", 70, "postgresql", r"\bpostgresql_licen[sc]e\b"),
    ("curl", 70, "curl", r"\bcurl_licen[sc]e\b"),
    ("ftl", 70, "freetype", r"\bfreetype_(?:project_)?licen[sc]e\b"),
    ("ijg", 70, "jpeg", r"\bindependent_jpeg_group\b"),
    ("icu", 70, "icu", r"\bicu_licen[sc]e\b"),
    ("unicode", 70, "unicode", r"\bunicode_(?:inc_)?licen[sc]e(?:_agreement)?\b"),
    ("w3c", 70, "w3c", r"\bw3c_(?:software_(?:notice_and_)?)?licen[sc]e\b"),
    ("ms-pl", 70, "microsoft", r"\bmicrosoft_public_licen[sc]e\b"),
    ("ms-rl", 70, "microsoft", r"\bmicrosoft_reciprocal_licen[sc]e\b"),
    ("ms-pl", 65, "ms-pl", r"\bms-pl\b"),
    ("upl-1.0", 70, "universal permissive", r"\buniversal_permissive_licen[sc]e\b"),
    ("afl-3.0", 90, "academic", r"\bacademic_free_licen[sc]e_(?:version_)?3\.0\b"),
    ("afl-2.1", 90, "academic", r"\bacademic_free_licen[sc]e_(?:version_)?2\.1\b"),
    ("afl", 70, "academic", r"\bacademic_free_licen[sc]e\b"),
    ("osl-3.0", 90, "open software", r"\bopen_software_license_(?:version_)?3\.0\b"),
    ("osl", 70, "open software", r"\bopen_software_license\b"),
    ("ecl-2.0", 70, "educational community", r"\beducational_community_licen[sc]e\b"),
    ("ofl-1.1", 90, "font", r"\b(?:sil_)?open_font_licen[sc]e_(?:version_)?1\.1\b"),
    ("ofl", 70, "font", r"\b(?:sil_)?open_font_licen[sc]e\b"),
    ("odbl-1.0", 70, "database", r"\bopen_database_licen[sc]e\b"),
    ("odc-by-1.0", 70, "open commons", r"\bopen_data_commons_attribution_licen[sc]e\b"),
    ("pddl-1.0", 70, "open commons", r"\bopen_data_commons_public_domain\b"),
    ("gfdl", 70, "gnu documentation", r"\bgnu_free_documentation_licen[sc]e\b"),
    ("gfdl-1.3", 90, "gnu documentation", r"\bgnu_free_documentation_licen[sc]e_(?:version_)?1\.3\b"),
    ("gfdl-1.2", 90, "gnu documentation", r"\bgnu_free_documentation_licen[sc]e_(?:version_)?1\.2\b"),
    ("gpl", 80, "gnu foundation", r"under_the_terms_of_the_gnu_general_public_licen[sc]e_as_published_by_the_free_software_foundation"),
    ("lgpl", 80, "gnu foundation", r"under_the_terms_of_the_gnu_lesser_general_public_licen[sc]e_as_published_by_the_free_software_foundation"),
    ("agpl", 80, "gnu foundation", r"under_the_terms_of_the_gnu_affero_general_public_licen[sc]e_as_published_by_the_free_software_foundation"),
    ("gpl", 50, "either later version", r"\beither_version_\d(?:\.\d)?_of_the_licen[sc]e_or_at_your_option_any_later_version\b"),
    ("gpl-classpath-exception", 90, "classpath", r"\bclasspath_exception\b"),
    ("gpl-gcc-exception", 90, "gcc", r"\bgcc_runtime_library_exception\b"),
    ("cddl-1.0", 90, "common development", r"\bcommon_development_and_distribution_licen[sc]e_(?:cddl_)?(?:version_)?1\.0\b"),
    ("cddl", 70, "common development", r"\bcommon_development_and_distribution_licen[sc]e\b"),
    ("cpl-1.0", 70, "common public", r"\bcommon_public_licen[sc]e\b"),
    ("ipl-1.0", 70, "ibm public", r"\bibm_public_licen[sc]e\b"),
    ("apsl-2.0", 70, "apple public", r"\bapple_public_source_licen[sc]e\b"),
    ("nposl-3.0", 70, "non-profit open", r"\bnon-profit_open_software_licen[sc]e\b"),
    ("rpl-1.5", 70, "reciprocal public", r"\breciprocal_public_licen[sc]e\b"),
    ("sleepycat", 70, "sleepycat", r"\bsleepycat_licen[sc]e\b"),
    ("vim", 70, "vim", r"\bvim_licen[sc]e\b"),
    ("tcl", 70, "tcl", r"\btcl/tk_licen[sc]e\b"),
    ("beerware", 70, "beer-ware", r"\bbeer-ware_licen[sc]e\b"),
    ("json", 80, "evil", r"\bshall_be_used_for_good_not_evil\b"),
    ("busl-1.1", 70, "business source", r"\bbusiness_source_licen[sc]e\b"),
    ("sspl-1.0", 70, "server side public", r"\bserver_side_public_licen[sc]e\b"),
    ("elastic-2.0", 70, "elastic", r"\belastic_licen[sc]e\b"),
    ("commons-clause", 70, "commons clause", r"\bcommons_clause\b"),
    ("polyform-noncommercial", 70, "polyform", r"\bpolyform_noncommercial_licen[sc]e\b"),
    ("openrail", 70, "rail", r"\b(?:bigscience_|creativeml_)?open_?rail(?:-m)?\b"),
    ("proprietary", 60, "confidential", r"\bproprietary_and_confidential\b"),
    ("all-rights-reserved", 60, "rights reserved", r"\ball_rights_reserved\b"),
    ("apache-2.0", 91, "licensed apache", r"licensed_under_the_apache_licen[sc]e_version_2\.0"),
    ("apache-2.0", 80, "limitations", r"see_the_licen[sc]e_for_the_specific_language_governing_permissions_and_limitations"),
    ("apache-2.0", 80, "distributed basis", r"distributed_under_the_licen[sc]e_is_distributed_on_an_as_is_basis"),
    ("apache-2.0-llvm-exception", 95, "llvm", r"\bapache[\s-]2\.0_with_llvm_exceptions?\b|\bllvm_exceptions_to_the_apache_2\.0_licen[sc]e\b"),
    ("mit", 80, "above notice included", r"the_above_copyright_notice_and_this_permission_notice_shall_be_included_in_all_copies"),
    ("mit", 70, "mit", r"\blicensed_under_(?:the_)?mit\b"),
    ("mit-feh", 70, "feh", r"\bfeh_licen[sc]e\b"),
    ("mit-enna", 70, "enna", r"\benna_licen[sc]e\b"),
    ("mit-cmu", 70, "cmu", r"\bcmu_licen[sc]e\b"),
    ("hpnd", 80, "permission modify purpose fee", r"permission_to_use_copy_modify_and_distribute_this_software_and_its_documentation_for_any_purpose_(?:and_)?without_fee"),
    ("hpnd", 70, "historical permission", r"\bhistorical_permission_notice_and_disclaimer\b"),
    ("bsd", 80, "redistributions retain", r"redistributions_of_source_code_must_retain_the_above_copyright"),
    ("bsd", 80, "redistributions reproduce", r"redistributions_in_binary_form_must_reproduce_the_above_copyright"),
    ("bsd-4-clause", 85, "advertising", r"all_advertising_materials_mentioning_features_or_use_of_this_software_must_display"),
    ("bsd-3-clause-clear", 95, "clear bsd", r"\bclear_bsd_licen[sc]e\b|\bbsd_3_clause_clear\b"),
    ("bsd-3-clause-lbnl", 90, "lawrence berkeley", r"\blawrence_berkeley_national_labs?_bsd\b"),
    ("bsd-2-clause-patent", 95, "bsd patent", r"\bbsd_(?:2_clause_)?(?:plus_)?patent(?:_licen[sc]e)?\b"),
    ("bsd-1-clause", 90, "bsd", r"\b(?:1|one)_clause_bsd\b|\bbsd_(?:1|one)_clause\b"),
    ("bsd-source-code", 70, "bsd source", r"\bbsd_source_code_attribution\b"),
    ("bsd-protection", 70, "bsd protection", r"\bbsd_protection_licen[sc]e\b"),
    ("isc", 80, "permission distribute granted", r"permission_to_use_copy_modify_and(?:_or)?_distribute_this_software_(?:and_its_documentation_)?for_any_purpose_with_or_without_fee_is_hereby_granted"),
    ("zlib", 80, "altered plainly", r"altered_source_versions_must_be_plainly_marked_as_such"),
    ("bsl-1.0", 80, "obtaining accompanying", r"obtaining_a_copy_of_the_software_and_accompanying_documentation_covered_by_this_licen[sc]e"),
    ("unlicense", 80, "anyone publish", r"anyone_is_free_to_copy_modify_publish_use_compile_sell_or_distribute_this_software"),
    ("public-domain", 60, "dedicated public domain", r"\bdedicated_to_the_public_domain\b"),
    ("public-domain", 60, "placed public domain", r"\bplaced_in_(?:the_)?public_domain\b"),
    ("blessing", 80, "blessing", r"in_place_of_a_legal_notice_here_is_a_blessing"),
    ("cc0-1.0", 85, "waive", r"\bwaived?_all_copyright_and_related_(?:or_neighbou?ring_)?rights\b"),
    ("cc0-1.0", 85, "creative commons zero", r"\bcreative_commons_zero\b"),
    ("gpl", 80, "free redistribute modify gnu", r"free_software_you_can_redistribute_it_and(?:_or)?_modify_it_under_the_terms_of_the_gnu_general_public_licen[sc]e"),
    ("lgpl", 80, "free redistribute modify gnu", r"free_software_you_can_redistribute_it_and(?:_or)?_modify_it_under_the_terms_of_the_gnu_(?:lesser|library)_general_public_licen[sc]e"),
    ("agpl", 80, "free redistribute modify affero", r"free_software_you_can_redistribute_it_and(?:_or)?_modify_it_under_the_terms_of_the_gnu_affero_general_public_licen[sc]e"),
    ("gpl", 71, "received gnu", r"you_should_have_received_a_copy_of_the_gnu_general_public_licen[sc]e"),
    ("lgpl", 71, "received gnu", r"you_should_have_received_a_copy_of_the_gnu_(?:lesser|library)_general_public_licen[sc]e"),
    ("agpl", 71, "received affero", r"you_should_have_received_a_copy_of_the_gnu_affero_general_public_licen[sc]e"),
    ("gpl", 55, "gnu.org/licenses", r"gnu\.org/licenses/gpl\b"),
    ("gpl-2.0", 85, "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", 85, "gnu.org/licenses", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl-2.1", 85, "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", 85, "gnu.org/licenses", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3.0", 85, "gnu.org/licenses", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl", 80, "gnu.org/licenses", r"gnu\.org/licenses/fdl\b"),
    ("gfdl", 70, "gfdl", r"\bgfdl\b"),
    ("gpl-font-exception", 90, "font", r"\bfont_(?:embedding_)?exception_to_the_gpl\b|\bgpl_font_exception\b"),
    ("gpl-autoconf-exception", 90, "autoconf", r"\bautoconf_(?:configure_script_)?exception\b"),
    ("gpl-bison-exception", 90, "bison", r"\bbison_(?:parser_)?exception\b"),
    ("gpl-linking-exception", 90, "linking", r"\blinking_exception\b"),
    ("gpl-openssl-exception", 90, "openssl", r"\bopenssl_(?:linking_)?exception\b"),
    ("gpl-syscall-note", 90, "linux-syscall-note", r"\blinux-syscall-note\b"),
    ("mpl-2.0", 80, "mozilla.org/mpl", r"mozilla\.org/mpl/2\.0"),
    ("mpl-2.0", 80, "subject terms mozilla", r"subject_to_the_terms_of_the_mozilla_public_licen[sc]e_v(?:ersion)?_?\.?_?2\.0"),
    ("mpl-2.0-no-copyleft-exception", 95, "incompatible secondary", r"incompatible_with_secondary_licen[sc]es"),
    ("npl-1.1", 70, "netscape public", r"\bnetscape_public_licen[sc]e\b"),
    ("epl-1.0", 80, "eclipse.org/legal", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", 80, "eclipse.org/legal", r"eclipse\.org/legal/epl-2\.0"),
    ("edl-1.0", 70, "eclipse distribution", r"\beclipse_distribution_licen[sc]e\b"),
    ("cddl", 80, "opensource.org/licenses/cddl", r"opensource\.org/licenses/cddl"),
    ("cddl", 65, "cddl", r"\bcddl\b"),
    ("osi-mit", 60, "opensource.org/licenses/mit", r"opensource\.org/licenses/mit\b"),
    ("osi-bsd", 60, "opensource.org/licenses/bsd", r"opensource\.org/licenses/bsd"),
    ("osi-isc", 60, "opensource.org/licenses/isc", r"opensource\.org/licenses/isc\b"),
    ("osi-apache", 60, "opensource.org/licenses/apache", r"opensource\.org/licenses/apache"),
    ("osi-artistic", 60, "opensource.org/licenses/artistic", r"opensource\.org/licenses/artistic"),
    ("artistic-1.0-perl", 90, "artistic perl", r"\bperl_artistic_licen[sc]e\b|\bartistic_licen[sc]e_perl\b"),
    ("clarified-artistic", 90, "clarified artistic", r"\bclarified_artistic_licen[sc]e\b"),
    ("qpl-1.0", 70, "public", r"\bq_public_licen[sc]e\b"),
    ("spl-1.0", 70, "sun public", r"\bsun_public_licen[sc]e\b"),
    ("sissl", 70, "sun industry", r"\bsun_industry_standards_source_licen[sc]e\b"),
    ("rpsl-1.0", 70, "realnetworks", r"\brealnetworks_public_source_licen[sc]e\b"),
    ("nokia", 70, "nokia open", r"\bnokia_open_source_licen[sc]e\b"),
    ("intel", 70, "intel open", r"\bintel_open_source_licen[sc]e\b"),
    ("nasa-1.3", 70, "nasa open", r"\bnasa_open_source_agreement\b"),
    ("ngpl", 70, "nethack", r"\bnethack_general_public_licen[sc]e\b"),
    ("motosoto", 70, "motosoto", r"\bmotosoto_open_source_licen[sc]e\b"),
    ("sybase", 70, "sybase open watcom", r"\bsybase_open_watcom_public_licen[sc]e\b"),
    ("watcom-1.0", 65, "open watcom", r"\bopen_watcom_licen[sc]e\b"),
    ("xnet", 70, "net", r"\bx\.net_licen[sc]e\b"),
    ("xfree86-1.1", 70, "xfree86", r"\bxfree86_licen[sc]e\b"),
    ("vsl-1.0", 70, "vovida", r"\bvovida_software_licen[sc]e\b"),
    ("fair", 70, "fair", r"\bfair_licen[sc]e\b"),
    ("frameworx", 70, "frameworx", r"\bframeworx_(?:open_)?licen[sc]e\b"),
    ("entessa", 70, "entessa", r"\bentessa_public_licen[sc]e\b"),
    ("eudatagrid", 70, "datagrid", r"\beu_datagrid_software_licen[sc]e\b"),
    ("eiffel-forum", 70, "eiffel forum", r"\beiffel_forum_licen[sc]e\b"),
    ("lucent-plan9", 70, "lucent public", r"\blucent_public_licen[sc]e\b"),
    ("catosl-1.1", 70, "computer associates", r"\bcomputer_associates_trusted_open_source_licen[sc]e\b"),
    ("cnri-python", 70, "cnri", r"\bcnri_(?:python_)?(?:open_source_)?licen[sc]e\b"),
    ("cpal-1.0", 70, "common public attribution", r"\bcommon_public_attribution_licen[sc]e\b"),
    ("cua-opl-1.0", 70, "cua office", r"\bcua_office_public_licen[sc]e\b"),
    ("liliq", 70, "liliq", r"\bliliq-(?:p|r|rplus)\b"),
    ("multics", 70, "multics", r"\bmultics_licen[sc]e\b"),
    ("naumen", 70, "naumen", r"\bnaumen_public_licen[sc]e\b"),
    ("oclc-2.0", 70, "oclc", r"\boclc_(?:research_)?public_licen[sc]e\b"),
    ("ogtsl", 70, "open group test", r"\bopen_group_test_suite_licen[sc]e\b"),
    ("rscpl", 70, "ricoh", r"\bricoh_source_code_public_licen[sc]e\b"),
    ("simpl-2.0", 70, "simple public", r"\bsimple_public_licen[sc]e\b"),
    ("wxwindows", 70, "wxwindows", r"\bwxwindows_library_licen[sc]e\b"),
    ("bittorrent-1.1", 70, "bittorrent", r"\bbittorrent_open_source_licen[sc]e\b"),
    ("cal-1.0", 70, "cryptographic autonomy", r"\bcryptographic_autonomy_licen[sc]e\b"),
    ("mulanpsl-2.0", 80, "mulan psl", r"\bmulan_psl_v?2\b"),
    ("mulanpsl", 70, "mulan permissive", r"\bmulan_permissive_software_licen[sc]e\b"),
    ("etalab-2.0", 70, "etalab", r"\b(?:etalab_)?licence_ouverte_(?:open_licence_)?etalab\b|\betalab_open_licen[sc]e\b"),
    ("ogl-uk-3.0", 90, "open government", r"\bopen_government_licen[sc]e_v(?:ersion)?_?3\.0\b"),
    ("ogl-uk", 70, "open government", r"\bopen_government_licen[sc]e\b"),
    ("cdla-permissive", 70, "community data permissive", r"\bcommunity_data_licen[sc]e_agreement_permissive\b"),
    ("cdla-sharing", 70, "community data sharing", r"\bcommunity_data_licen[sc]e_agreement_sharing\b"),
    ("free-art-1.3", 70, "free art", r"\bfree_art_licen[sc]e\b"),
    ("cern-ohl", 70, "cern hardware", r"\bcern_open_hardware_licen[sc]e\b"),
    ("tapr-ohl-1.0", 70, "tapr hardware", r"\btapr_open_hardware_licen[sc]e\b"),
    ("solderpad", 70, "solderpad", r"\bsolderpad_hardware_licen[sc]e\b"),
    ("bitstream-vera", 70, "bitstream vera", r"\bbitstream_vera_(?:fonts?_)?(?:copyright|licen[sc]e)\b"),
    ("arphic", 70, "arphic", r"\barphic_public_licen[sc]e\b"),
    ("ipa", 70, "ipa font", r"\bipa_font_licen[sc]e\b"),
    ("ubuntu-font-1.0", 70, "ubuntu font", r"\bubuntu_font_licen[sc]e\b"),
    ("gust-font", 70, "gust font", r"\bgust_font_licen[sc]e\b"),
    ("knuth-ctan", 70, "knuth ctan", r"\bknuth_ctan_licen[sc]e\b"),
    ("imagemagick", 70, "imagemagick", r"\bimagemagick_licen[sc]e\b"),
    ("bzip2", 70, "bzip2", r"\bbzip2_licen[sc]e\b"),
    ("libtiff", 70, "libtiff", r"\blibtiff_licen[sc]e\b"),
    ("netcdf", 70, "netcdf", r"\bnetcdf_licen[sc]e\b"),
    ("sgi-b-2.0", 70, "sgi free", r"\bsgi_free_software_licen[sc]e\b"),
    ("tcp-wrappers", 70, "tcp wrappers", r"\btcp_wrappers_licen[sc]e\b"),
    ("info-zip", 70, "info-zip", r"\binfo-zip_licen[sc]e\b"),
    ("wordnet", 70, "wordnet", r"\bwordnet_licen[sc]e\b"),
    ("naist-2003", 70, "naist", r"\bnaist_licen[sc]e\b"),
    ("hippocratic", 70, "hippocratic", r"\bhippocratic_licen[sc]e\b"),
    ("parity", 70, "parity public", r"\bparity_public_licen[sc]e\b"),
    ("prosperity", 70, "prosperity public", r"\bprosperity_public_licen[sc]e\b"),
    ("blueoak-1.0.0", 70, "blue oak", r"\bblue_oak_model_licen[sc]e\b"),
    ("anti-996", 70, "996", r"\banti[\s-]996_licen[sc]e\b"),
    ("confluent-community", 70, "confluent community", r"\bconfluent_community_licen[sc]e\b"),
    ("redis-sal", 70, "redis source", r"\bredis_source_available_licen[sc]e\b"),
    ("timescale", 70, "timescale", r"\btimescale_licen[sc]e\b"),
    ("polyform-shield", 70, "polyform shield", r"\bpolyform_shield_licen[sc]e\b"),
    ("polyform-small-business", 70, "polyform small business", r"\bpolyform_small_business_licen[sc]e\b"),
    ("llama-community", 70, "llama community", r"\bllama(?:_\d(?:\.\d)?)?_community_licen[sc]e\b"),
    ("gemma-terms", 70, "gemma terms", r"\bgemma_terms_of_use\b"),
    ("proprietary", 60, "trade secrets", r"\bcontains_(?:proprietary_)?(?:information_and_)?trade_secrets\b"),
    ("proprietary", 60, "reproduction forbidden", r"\breproduction_(?:or_(?:distribution|disclosure)_)?is_strictly_forbidden\b"),
    ("proprietary", 60, "end user agreement", r"\bend[\s-]user_licen[sc]e_agreement\b"),
    ("non-commercial", 55, "non commercial only", r"\bfor_non[\s-]?commercial_(?:use|purposes)_only\b"),
    ("evaluation", 55, "evaluation only", r"\bfor_evaluation_(?:use|purposes)_only\b"),
    ("freeware", 50, "freeware", r"\bfreeware_licen[sc]e\b"),
    ("shareware", 50, "shareware", r"\bshareware_licen[sc]e\b"),
]

#: Families built by rule: name, keyword, versions.
GNU = [("gpl", "gnu_general_public_licen[sc]e", "gpl", ["1.0", "2.0", "3.0"]), ("lgpl", "gnu_(?:lesser|library)_general_public_licen[sc]e", "lgpl", ["2.0", "2.1", "3.0"]), ("agpl", "(?:gnu_)?affero_general_public_licen[sc]e", "agpl", ["1.0", "3.0"])]
PUBLIC = [("mpl", "mozilla_public_licen[sc]e", "mozilla", ["1.0", "1.1", "2.0"]), ("epl", "eclipse_public_licen[sc]e", "eclipse", ["1.0", "2.0"]), ("eupl", "european_union_public_licen[sc]e", "european union public", ["1.0", "1.1", "1.2"]), ("cecill", "cecill(?:_free_software)?_licen[sc]e", "cecill", ["1.0", "2.0", "2.1"]), ("lppl", "latex_project_public_licen[sc]e", "latex project", ["1.0", "1.2", "1.3"])]
CC_ELEMENTS = [("by", "attribution"), ("by-sa", "attribution_share_?alike"), ("by-nd", "attribution_no_?deriv(?:ative)?s?(?:_works)?"), ("by-nc", "attribution_non_?commercial"), ("by-nc-sa", "attribution_non_?commercial_share_?alike"), ("by-nc-nd", "attribution_non_?commercial_no_?deriv(?:ative)?s?(?:_works)?")]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
SPDX = """0bsd afl-3.0 agpl-3.0 apache-1.1 apache-2.0 artistic-2.0 bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1 cc-by-4.0 cc-by-sa-4.0
cc-by-nc-4.0 cc0-1.0 cddl-1.0 cecill-2.1 ecl-2.0 epl-1.0 epl-2.0 eupl-1.2 gpl-1.0 gpl-2.0 gpl-3.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0 lppl-1.3c mit mit-0
mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 osl-3.0 postgresql python-2.0 unicode-dfs-2016 unlicense upl-1.0 vim wtfpl x11 zlib zpl-2.1""".split()


def _version(v: str) -> str:
    """The version's number, its closing .0 optional, in brackets or after a comma."""
    number = re.escape(v.removesuffix(".0")) + (r"(?:\.0)?" if v.endswith(".0") else "")
    return rf"{VERSION}{number}(?![\d.]*\d)"


def _all() -> list[tuple[str, int, str, str]]:
    out = list(SIGNATURES)
    for label, name, keyword, versions in GNU:
        spelled = "affero public" if label == "agpl" else "gnu public"
        out.append((label, 70, spelled, rf"\b{name}\b"))
        out.append((label, 60, keyword, rf"\b(?:gnu_)?{keyword}(?:_licen[sc]ed?|v\d)\b"))
        for v in versions:
            for tail, later in (("-or-later", r"_(?:\([^()]*\)_)?(?:or_(?:\(at_your_option\)_)?(?:any_)?later|or_newer)"), ("-only", "_only"), ("", "")):
                priority = 96 if tail else 90
                out.append((f"{label}-{v}{tail}", priority, spelled, rf"\b{name}{_version(v)}{later}"))
                out.append((f"{label}-{v}{tail}", priority, keyword, rf"\b{keyword}{VERSION}{re.escape(v.removesuffix('.0'))}(?:\.0)?(?![\d.]*\d){later or ''}"))
            out.append((f"{label}-{v}-or-later", 96, keyword, rf"\b{keyword}[\s-]?v?{re.escape(v.removesuffix('.0'))}(?:\.0)?\+"))
    for label, name, keyword, versions in PUBLIC:
        out.append((label, 70, keyword, rf"\b{name}\b"))
        for v in versions:
            out.append((f"{label}-{v}", 90, keyword, rf"\b{name}{_version(v)}"))
            out.append((f"{label}-{v}", 85, label, rf"\b{label}{VERSION}{re.escape(v)}(?![\d.]*\d)"))
    for short, name in CC_ELEMENTS:
        spelled = short.replace("-", "_")
        out.append((f"cc-{short}", 60 + len(short), "cc", rf"\bcc_{spelled}\b"))
        out.append((f"cc-{short}", 70 + len(short), "creative commons", rf"\bcreative_commons_{name}\b"))
        for v in CC_VERSIONS:
            out.append((f"cc-{short}-{v}", 85 + len(short), "cc", rf"\bcc_{spelled}_{re.escape(v)}(?![\d.]*\d)"))
            out.append((f"cc-{short}-{v}", 85 + len(short), "creativecommons", rf"creativecommons\.org/licenses/{short}/{re.escape(v)}\b"))
            out.append((f"cc-{short}-{v}", 85 + len(short), "creative commons", rf"\bcreative_commons_{name}_(?:international_|unported_|generic_)?(?:public_)?(?:licen[sc]e_)?(?:version_)?{re.escape(v)}(?![\d.]*\d)"))
    out += [("cc0-1.0", 90, "cc0", r"\bcc0(?:_1\.0)?\b"), ("cc0-1.0", 90, "creativecommons", r"creativecommons\.org/publicdomain/zero/1\.0"), ("cc-pdm-1.0", 90, "creativecommons", r"creativecommons\.org/publicdomain/mark/1\.0")]
    for name in SPDX:
        out.append((name, 99, "spdx-license-identifier", rf"spdx-license-identifier:_?{re.escape(name)}(?![\w.-])"))
        if name.split("-")[0] in ("gpl", "lgpl", "agpl"):
            out += [(f"{name}-{tail}", 99, "spdx-license-identifier", rf"spdx-license-identifier:_?{re.escape(name)}(?:-{tail}{'|[+]' if tail == 'or-later' else ''})(?![\w.-])") for tail in ("only", "or-later")]
    return out


def compiled() -> list[Rule]:
    """All rules, their gaps written out, in order of priority."""
    gap = lambda p: re.sub(r"(?<!\\)_(?![?{])", lambda m: GAP, p.replace("_?", GAP[:-1] + "*"))
    return sorted((Rule(label, priority, keyword, re.compile(gap(pattern))) for label, priority, keyword, pattern in _all()), key=lambda r: (-r.priority, r.label))
