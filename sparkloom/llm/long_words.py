"""Ordinary long words: the part of the dictionary of ``secret_novelty`` that keeps prose from looking like secrets. English first of all, some German, Spanish and French."""

WORDS = """
cryptographically misunderstanding internationalization straightforward responsibility characteristics organization international opportunities
independently circumstances administrator administration infrastructure understanding communication significantly nevertheless simultaneously
automatically unfortunately entertainment transportation pharmaceutical representative determination demonstration collaboration accomplishment
acknowledgement advertisement agricultural constitutional contemporary controversial extraordinary philosophical psychological revolutionary
sophisticated technological manufacturing neighbourhood photography professional relationship scholarship subscription sustainability vulnerability
subscriptions certification cybersecurity confidentiality customerAccountNumber verificationToken refresh_interval_seconds max_retry_attempts
session_timeout_minutes state-of-the-art password-protected Datenschutzgrundverordnung Geschwindigkeitsbegrenzung Verantwortung Zusammenarbeit
Zusammenfassung Veranstaltung Informationen Entwicklung Unternehmen Gesellschaft Wissenschaft Benutzername Sicherheit Verschlüsselung
Authentifizierung Anmeldung Einstellungen Voraussetzung Veröffentlichung wahrscheinlich unterschiedlich selbstverständlich verschiedene insbesondere
entsprechend responsabilidad desarrolladores administración información conocimiento comunicación universidad organización funcionamiento
procedimiento establecimiento departamento internacional especialmente generalmente aproximadamente posteriormente anteriormente autenticación
configuración contraseña características oportunidades investigación développement gouvernement aujourd'hui renseignements établissement environnement
connaissance fonctionnement particulièrement généralement immédiatement authentification configuration informations utilisateur développeurs
caractéristiques enseignement responsabilité organisation internationale pregenerated symcryptrun voluntarily territories parallelizable preinitialize
sanitization equivalences authorities vectorization conditioned disadvantage transcoding reconstruction uncommitted compressors spreadsheet
standardization aggregating predecessors unambiguously doublequote containment libsmartcols jameswestby instrumenting uncompressing preparatory
insufficiently drastically decorations dramatically anticipated unrestricted illustration declarative environmental interceptor programmers
parametrize manipulations unacceptable engineering socketserver jesserayadkins copyrightable unreasonably cancelation substitition incompatibly
shortcomings dissemination optimistically localdomain mysteriously reproducibly misalignment backgrounds destructive unification tokensource
blacklisted categoricals synchronizes facilitates metaclasses classmethods multicolumn manipulates refsynopsisdiv superblocks virtualization
locutusofborg certifications installcheck reconfigured implication uninstalling presumption overridable inadvertent polynomials preservation
scaffolding disallowing distributor competition authenticating topological synchronizing namedtuples equivalently tokenization constructions
obligations distributable synchronisation designation disassembling nomenclature inappropriately unauthenticated comfortable generalization
enumerating replaceable decremented unprintable interpolated interruptible libcryptsetup arrangements indications pseudorandom reimplement
compilations grammatical multiplications independence classifiers refinements homogeneous controllable participate tracemalloc alternating disassembly
rectangular inheritable partnership transferable reconfiguring preprocessors autocompletion rearrangement suppressions invalidates meaningfully
autogenerate autocomplete recoverable factorization persistently heterogeneous subpackages disassemble interdependencies counterclaim unreproducible
intervention signedinteger provisional deterministically registrations subinterpreters collaborator oldoldstable namespacing generically keybindings
disambiguation inconvenient programmatic intercepted interruption deallocating accessibility typesetting personality canonicalized systematically
overloading compatability theoretically enumerations considerable decrementing supplemental alterations collaborative restructured enforceable
bootstrapped disconnection nonsensical clongdouble parenthesized highlighter unprocessed misconfigured statistical irrespective deduplication
calibration insensitively datarootdir surrogatepass collaborators operational scanltranstree privatization interprocedural liboffloadmic jeffreyalaw
radhakrishnan alphabetize trippelsdorf libertysurf walfridsson caviumnetworks navidrahimi venkataramanan libdecnumber substitutes mishandling
unauthorized reintroduce prereleases nondeterministic complements comprehensions relationships customizations enforcement refentrytitle remembering
mostlyclean fixincludes passphrases renegotiation recompiling uninstallation compensation redundancies unsuccessful misspellings subsumption
multiplicative prominently multidimensional interleaved correspondence persistence invalidation hypothetical deactivated endorsement unavoidable
responsibilities conveniently legitimately autodetected interrupting incrementally accompanied protections typographical reinterpreting relicensing
disclaimers reinitialized recommending performances idempotency ineffective misconfiguration maliciously addressable utilization reconstructed
reservation administrative descendants convergence continuations functionally breakpoints unenforceable translationproject encapsulation interference
disconnecting inconsistently metacharacters authoritative maintainability orientation organizations predecessor publication susceptible affiliation
positioning fedoraproject recompilation investigation realignment investigated validations accelerated semantically initialised faulthandler
intermediary repetitions joshtriplett investigating acquisition reallocating autodetection transitioned discriminated searchsorted deduplicate
horizontally interfering unregistered superproject indentedblock jurisdictions dependences establishes fingerprints temporaries indeterminate
observations unconstrained internationalized distinguishes irrevocable localstatedir reformatting nolinebreak transparency hierarchies standardize
illustrated elementwise coordination customizable probabilities encapsulate ambiguities transformer interoperable individuals forthcoming accelerators
redirections unformatted abstractions concatenating configparser rudimentary consequential infringement reconfiguration reinitialization unrecoverable
introductory multithreading deprecating mismatching lexicographically understandable connectivity preexisting partitioned stringified dimensional
encapsulated permutations restructure acknowledges obsolescent importantly discoverable serializable convertible correlation malfunction incidentally
longstanding nonblocking misspelling optimisation discovering measurements nonexisting instrumentation unreferenced accumulator permutation
incrementing incorporating nonnegative normalizing jurisdiction degradation communicating reformatted reinitialize multiplying perspective refcounting
permissible instrumented deserialization sequentially deserialize flatbuffers universally unqualified monotonically conceptually encapsulates
sensitivity terminators redirecting speculation randomization arrangement integrating traditionally alternatively capitalized consequently
syntactically unambiguous denominator suppressing unintentional misbehaving destinations benchmarking predictions reintroduced acceleration
mutexinoutset simoesdiasvieira libbacktrace libsanitizer decompressing installable discrepancy simplifications manufacturer associating circumstance
unevaluated libquadmath preprocessed concurrency serializers customizing reimplementation neighboring synthesized parameterize alphanumeric
granularity localization reconstruct relocatable intellectual reallocation inaccessible fragmentation reproducibility interpolate meaningless
unbreakable restructuring progressive nonstandard intentional observation historically frequencies programmatically unmaintained restricting
speculative subroutines stylesheets distinguished merchantability thewrittenword constitutes regeneration broadcasting reorganized parameterized
mathematical backslashreplace prepackaged mkinstalldirs redistributed functioning dispatching distributes lexicographic reproducing backtracking
proportional investigate surrogateescape dereferences demonstrated canonicalization enumerators redistribution cryptography quantization
specialization precomputed pathological comprehension confirmation programlisting variablelist maintscript establishing interactively disappeared
recognizing illustrates unencrypted unicodedata housekeeping attribution composition unallocated resolutions transmitted undesirable consolidated
hierarchical incorporates simultaneous questionable clarifications specializations unintentionally superficial synchronized decompressor
reorganization disambiguate coefficient reconfigure generalized continuously interacting equivalence unfortunate interpreting rdsandiford libgfortran
translatable transactions intervening initializations lightweight presentation considerably decompressed segfaulting distinguishing decomposition
coefficients serializing subtracting discussions relocations administrators transformers approximation uninitialised backporting destructors
translators demonstrates aggregation subclassing accumulated propagating manipulated notifications transmission monkeypatch deserialized entrypoints
invalidated millisecond elimination selectively bidirectional distributors transparently representable accomplished completions substantially
transferring coopersmith deallocated supplementary identically comprehensive substituting permanently compressing unprivileged aggressively
capitalization partitioning theoretical placeholders clarification terminology considerations periodically interpreters interactions multiprocessing
unpredictable initialisation canonicalize encountering prerequisite completeness measurement announcement interchange contributing readthedocs
recommendations fundamental simplifying parametrized manipulating accompanying overflowing fallthrough subtraction commandline conventional
transforming differentiate complaining negotiation cryptographic preprocessing inappropriate synchronously deallocation contribution unimplemented
uninstalled reliability precompiled synchronize subcommands authenticate possibilities intermittent subsections proprietary reimplemented association
dereferenced prematurely unterminated counterparts derivatives preliminary accelerator counterpart translating alphabetically gitattributes
implications highlighted suitability downloading fingerprint approximately opportunity demonstrate disconnected abstractmethod unversioned
standardized arbitrarily autopkgtests transferred consideration microsecond demonstrating inefficient defaultdict subprocesses transitions querystring
recognition originating discouraged asynchronously prerequisites misrepresented acknowledgment abbreviated enhancement deliberately preferences
miscellaneous abbreviation computations indirection authenticated duplicating vulnerabilities consolidate multithreaded approximate finalization
fifthhorseman constrained transformations classification erroneously inadvertently replacements indefinitely surrounding initializes customization
copyrighted bootstrapping appreciated instantiating incremental boilerplate distinction probability autogenerated restrictive incorporate
abbreviations identification interpolation flexibility consequence regenerated inheritance conformance synchronization considering instantiation
registering simplification interoperability conservative outstanding cancellation alphabetical subsequently inconsistencies consequences predictable
haubenwallner parallelism initializers descriptive intersection coordinates substituted nanoseconds informational introspection notification
decompression versionchanged dereferencing efficiently suppression sufficiently transaction incremented concatenate enumeration consumption
inconsistency destruction instantiate redefinition acknowledge incompatibilities equivalents insufficient unconditional whitespaces occasionally
highlighting categorical introducing dictionaries additionally technically instantiated nonexistent informative uncompressed transitional segmentation
concatenation microseconds documenting transparent eliminating adjustments referencing maintaining intentionally understands codesourcery concurrently
multiplication normalization controlling credentials manipulation specialized parenthesis placeholder repositories conditionally synchronous
essentially communicate interesting insensitive abstraction redirection deprecations installations conditionals propagation unrecognized concatenated
incorporated conjunction contributions transformed established backslashes punctuation assumptions terminating overlapping distributing
incompatibility calculations interpretation refactoring occurrences substitutions recommendation registration duplication dataclasses underscores
accommodate workarounds introduction individually overwriting interrupted consecutive superfluous suggestions filesystems certificates calculating
constructing allocations regressions corrections preparation enhancements problematic identifying availability invocations serialization unreachable
asynchronous hexadecimal deterministic complicated specifications autopkgtest configuring constructors readability reproducible continuation
interaction contributed correctness initializing effectively unspecified possibility capabilities unnecessarily representations alternatives
configurable diagnostics undocumented milliseconds overwritten improvement transformation corresponds programming traditional dereference determining
conflicting certificate subdirectories recursively preprocessor substitution integration assignments consistently termination parentheses conventions
verification optimizations accidentally conversions combinations instruction temporarily constructed appropriately initializer sourceforge
versionadded authorization maintainers particularly unavailable inconsistent interactive intermediate differently configurations comparisons
encountered indentation distinguish necessarily identifiers authentication executables restrictions advertising calculation connections translations
interpreter construction differences responsible implementing environments staticmethod maintenance descriptors distributions represented dynamically
unconditionally significant subdirectory computation deprecation freedesktop uninitialized convenience constraints destination specifically
translation descriptions conditional hyphenation modifications declarations justification successfully consistency representing independent
improvements compression contributors potentially replacement interpreted substantial accordingly instructions combination architectures declaration
incorrectly optimization respectively classmethod initialized requirement architecture redistribute unsupported requirements compilation incompatible
definitions alternative constructor initialization development restriction representation installation contributor portability implementations
specification recommended modification unnecessary functionality immediately applications collections application directories annotations performance
dependencies limitations implemented appropriate corresponding permissions distribution description compatibility environment distributed
implementation documentation information
"""
