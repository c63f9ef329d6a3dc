"""Short texts written by hand, by kind; the classifier has never seen them."""

from __future__ import annotations

PROSE = [
    "We measured the flow for three days. The results did not change when the valve was closed, and so we kept it open.",
    "Nothing changes. The proof is short and is left to the reader, who will find it in any book on the subject.",
    "\\section{Setting}\nIn this section we recall how the field is defined. Let $f$ be a map on the disc; then\n\\begin{equation}\nf(z) = z^2 + c\n\\end{equation}\nis the family that we study here, and $c$ is its only parameter.",
    "Die Messung wurde am Morgen wiederholt. Das Ergebnis war das gleiche, obwohl die Temperatur in der Halle gestiegen war.",
    "Nous avons répété la mesure le matin. Le résultat est le même, bien que la température de la salle ait changé.",
    "Repetimos la medida por la mañana. El resultado es el mismo, aunque la temperatura de la sala había subido.",
    "\\documentclass{article}\n\\usepackage{amsmath}\n\\newcommand{\\R}{\\mathbb{R}}\n\\begin{document}\nThe map is continuous on $\\R$, as was shown in \\cite{a}. It is not known whether this is also true\nfor maps of the plane, but we believe that it is.\n\\begin{thebibliography}{9}\n\\bibitem{a} A. Name, A title, J. Some 1 (1999), 1--2.\n\\bibitem{b} B. Name, Another title, J. Some 2 (2001), 3--4.\n\\end{thebibliography}\n\\end{document}",
    "Remarks\n\nThe sample was dried for two hours before it was weighed. After that it was kept in the dark, where it lost its colour within a week.",
    "There are two reasons for this choice. The first is speed: a small model is trained within the hour. The second is that its errors are easy to read.",
    "\\begin{itemize}\n\\item We show that the operator is bounded from below when the weights are positive.\n\\item If this were false, then the sum would have to diverge, which it does not.\n\\end{itemize}\nBoth claims are proved in the last section of the paper.",
    "Es ist nicht bekannt, ob diese Annahme auch für den allgemeinen Fall gilt. Wir zeigen hier nur, dass sie für kleine Werte von $x$ nicht verletzt ist.",
    "As a consequence, the error grows with the square of the step, so that the mesh must be refined more than once. We have done this for all of the runs in the table below.\n\\begin{tabular}{ll}\na & 1 \\\\\nb & 2 \\\\\n\\end{tabular}",
]

JUNK = [
    "\n".join(f"row {i} & {i * 7 % 13}.{i * 31 % 97} & {i * 11 % 89}.{i} \\\\ \\hline" for i in range(30)),
    "\n".join(f"\\bibitem{{key{i}}} A. Name, B. Other, \\emph{{On some matter {i}}}, J. Matters \\textbf{{{i}}} ({1980 + i}), {i}--{i + 9}." for i in range(20)),
    "\n".join(f"index term {i}, {i * 3}, {i * 5}, {i * 17 % 200}" for i in range(30)),
    "\\begin{verbatim}\n" + "\n".join(f"{i}.{i * 7 % 10}e+0{i % 3}\t{i * 13 % 100}.{i}\t{i}" for i in range(30)) + "\n\\end{verbatim}",
    "This page is blank.\n" * 30,
    "\\begin{align*}\n" + "\n".join(f"  x_{{{i}}} &= \\sum_{{k=1}}^{{n}} \\alpha_k^{{{i}}} + \\frac{{1}}{{{i + 1}}} \\\\" for i in range(15)) + "\n\\end{align*}",
    "\n".join(f"\\newcommand{{\\m{chr(97 + i)}}}{{\\mathbb{{{chr(65 + i)}}}}}" for i in range(26)),
    "\n".join(f"\\contentsline {{section}}{{\\numberline {{{i}}}Some heading}}{{{i * 2}}}{{}}%" for i in range(20)),
    "\n".join(f"def f{i}(x):\n    return x ** {i} if x > {i} else None" for i in range(12)),
    "\n".join(f"Overfull \\hbox ({i}.{i}pt too wide) in paragraph at lines {i}--{i + 4}\n! Undefined control sequence." for i in range(15)),
    "a l l o f t h e l e t t e r s a r e a p a r t a n d n o w o r d i s l e f t " * 8,
    "\n".join("".join("0123456789abcdef"[(i * 31 + j * 17 + i * j) % 16] for j in range(60)) for i in range(12)),
    "\n".join(f"\\input{{chap/part{i}}}" for i in range(25)),
    "term; other term; gradient; kernel; surface; local wave; tensor; cipher; weak map; strong map; " * 8,
    "%\n%\n",
    "\n".join(f"\\item[$x_{{{i}}}$] weak kernel" for i in range(20)),
    "weak of surface the holds in kernel by every is that map slow and to with ratio a local turns of we strong " * 6,
    "\n".join(f"On the {a} of the {b} and its use\nA note on {b} for a {a}\nWhat is the {a} in a {b}?" for a in ("kernel", "surface", "ratio") for b in ("mesh", "cache", "wave")),
]
